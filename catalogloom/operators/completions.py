"""Model calls in bulk: prompts, messages, providers, structured replies, one repair round, cost."""

from __future__ import annotations

import hashlib
import json
import string
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas
from ..functions import contracts as C
from ..functions.text import strip_json_fence
from ..session import settle_missing

# Price of a token and how many attempts a reply gets.
TOKEN_COST = 2e-8
MAX_ATTEMPTS = 2

# Fixed value: shown in a prompt when no title hint was given.
NO_HINT = "(ninguna)"

CONCEPT_SYSTEM = "You plan printable and downloadable products. Answer with one JSON object and nothing else."
LISTING_SYSTEM = "You write marketplace listings that are easy to find. Answer with one JSON object and nothing else."
REPAIR_SYSTEM = "The previous answer could not be used ({error}). Answer again with valid JSON only."

CONCEPT_TEMPLATE = """Plan one product.
pack={pack} type={pack_type} theme={theme}
pages={page_count} languages={languages} hint={hint}
Return {{"pages": [{{"id", "index", "prompt", "title"}}], "titles": {{language: title}}, "subtitle", "description_hint"}}.
Vary the pages within the theme {theme}; make every image prompt suit {pack_type}.
"""

LISTING_TEMPLATE = """Write listings for one product.
pack={pack} type={pack_type} theme={theme}
pages={page_total} languages={languages} formats={formats}
title_en={title_en} title_es={title_es} subtitle={subtitle} hint={hint}
Return {{"listings": [{{"marketplace", "language", "format", "title", "description", "tags", "price", "category"}}]}}
with one entry per marketplace and language.
"""


def fill(template: str, **columns: Column) -> Column:
    """A template with named slots as one concatenation; a missing value becomes empty text."""
    pieces = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if slot is not None:
            pieces.append(F.coalesce(columns[slot].cast("string"), F.lit("")))
    return F.concat(*pieces)


def concept_prompt(
    df: DataFrame, template: str = CONCEPT_TEMPLATE, pack: str = "pack", languages: str = "pack_languages"
) -> Column:
    """Concept prompt. The languages are those of the pack, not of the request."""
    hint = F.coalesce(F.nullif(F.col("title_hint"), F.lit("")), F.lit(NO_HINT))
    return fill(
        template,
        pack=F.col(pack),
        pack_type=F.col("pack_type"),
        theme=F.col("theme"),
        page_count=F.col("page_count"),
        languages=F.array_join(languages, ", "),
        hint=hint,
    )


def listing_prompt(df: DataFrame, template: str = LISTING_TEMPLATE, pack: str = "pack") -> Column:
    """Listing prompt. The languages and formats are those of the request."""
    return fill(
        template,
        pack=F.col(pack),
        pack_type=F.col("pack_type"),
        theme=F.col("theme"),
        page_total=F.size("pages"),
        languages=F.array_join("languages", ", "),
        formats=F.array_join("formats", ", "),
        title_en=F.col("titles")["en"],
        title_es=F.col("titles")["es"],
        subtitle=F.col("subtitle"),
        hint=F.col("description_hint"),
    )


def render_prompts(df: DataFrame, kind: str, template: str | None = None) -> DataFrame:
    """Adds ``system`` and ``user`` for the concept or the listing stage."""
    if kind == "concept":
        system, user = CONCEPT_SYSTEM, concept_prompt(df, template or CONCEPT_TEMPLATE)
    else:
        system, user = LISTING_SYSTEM, listing_prompt(df, template or LISTING_TEMPLATE)
    return df.withColumn("system", F.lit(system)).withColumn("user", user)


def build_messages(
    df: DataFrame, model: str, system: str = "system", user: str = "user", json_mode: bool = True
) -> DataFrame:
    """Adds the chat messages and the JSON request body."""

    def turn(role: str, text: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))

    body = [F.lit(model).alias("model"), F.col("messages"), F.lit(False).alias("stream")]
    if json_mode:
        body.append(F.lit("json").alias("format"))
    return df.withColumn("messages", F.array(turn("system", system), turn("user", user))).withColumn(
        "request", F.to_json(F.struct(*body))
    )


def extract_chat_content(raw: Column, style: str = "message") -> Column:
    """Reply text of a raw response: ``message.content``, or that of the first choice."""
    path = "$.message.content" if style == "message" else "$.choices[0].message.content"
    return F.coalesce(F.get_json_object(raw, path), F.lit(""))


class Provider(Protocol):
    """A model client: returns the reply text and the raw response."""

    def complete(self, system: str, user: str) -> tuple[str, dict]: ...


class ImageProvider(Protocol):
    """An image client: returns the bytes of one image."""

    def generate(self, prompt: str, aspect_ratio: str, size: str, quality: str) -> bytes: ...


class Ledger:
    """Replies paid for, as files in a shared folder: one for each slice of prompts, named by their hash.

    A task commits a slice before it goes on, so a task that is repeated, or a run that is started again,
    reads what is there and pays for the rest only. A file appears under its name in one step.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(folder)

    def path(self, prompts: list[tuple[str, str]]) -> str:
        return f"{self.base}/{hashlib.sha256(json.dumps(prompts).encode()).hexdigest()}.json"

    def read(self, path: str) -> list[tuple] | None:
        try:
            with self.files.open_input_stream(path) as held:
                return [tuple(r) for r in json.loads(held.read())]
        except FileNotFoundError:
            return None

    def write(self, path: str, rows: list[tuple]) -> None:
        draft = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(self.base, recursive=True)
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(rows).encode())
        self.files.move(draft, path)


def complete_batch(
    df: DataFrame, provider: Callable[[], Provider], parallelism: int | None = None, ledger: str | None = None, slice_rows: int = 16
) -> DataFrame:
    """One call per row of (…, system, user) through a client built once per partition.

    Adds content, raw and call_error. A failing call fills call_error and is not tried again here.
    Row batches stream through, so memory holds one Arrow batch whatever the partition size. The
    number of partitions bounds the number of concurrent clients; ``parallelism`` sets it, as a small
    table of prompts otherwise ends in few partitions.

    With ``ledger``, a shared folder, the replies to every ``slice_rows`` prompts are committed there as
    they come, and a repeated task does not call for them again; slices with a failed call are not kept.
    """
    df = df if parallelism is None else df.repartition(parallelism)
    added = [T.StructField(name, T.StringType()) for name in schemas.COMPLETION]
    schema = T.StructType([*df.schema.fields, *added])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, book = provider(), Ledger(ledger) if ledger else None

        def ask(system: str, user: str) -> tuple:
            try:
                content, raw = client.complete(system=system, user=user)
                return content, json.dumps(raw), None
            except Exception as error:  # one failed call must not fail its task
                return None, None, repr(error)

        def paid(prompts: list[tuple[str, str]]) -> list[tuple]:
            path = book.path(prompts)
            rows = book.read(path)
            if rows is None:
                rows = [ask(*p) for p in prompts]
                if all(r[2] is None for r in rows):
                    book.write(path, rows)
            return rows

        for batch in batches:
            prompts = list(zip(batch["system"], batch["user"]))
            if book:
                rows = [r for at in range(0, len(prompts), slice_rows) for r in paid(prompts[at : at + slice_rows])]
            else:
                rows = [ask(*p) for p in prompts]
            out = pd.DataFrame(rows, columns=schemas.COMPLETION, index=batch.index)
            yield pd.concat([batch, out], axis=1)

    return df.mapInPandas(call, schema)


# The canned replies of the offline provider.
PLACEHOLDER_LISTINGS = {
    "listings": [
        {
            "marketplace": "digital-a", "language": "en", "format": "digital",
            "title": "Placeholder Digital EN", "description": "Placeholder description.",
            "tags": ["tag1", "tag2", "tag3", "tag4", "tag5", "tag6", "tag7", "tag8"],
            "price": 4.99, "category": "placeholder",
        },
        {
            "marketplace": "digital-a", "language": "es", "format": "digital",
            "title": "Placeholder Digital ES", "description": "Descripción placeholder.",
            "tags": ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8"],
            "price": 4.99, "category": "placeholder",
        },
    ]
}
PLACEHOLDER_CONCEPT = {
    "pages": [
        {"id": "page_001", "index": 1, "prompt": "placeholder page 1", "title": "Page 1"},
        {"id": "page_002", "index": 2, "prompt": "placeholder page 2", "title": "Page 2"},
        {"id": "page_003", "index": 3, "prompt": "placeholder page 3", "title": "Page 3"},
    ],
    "titles": {"en": "Placeholder EN", "es": "Placeholder ES"},
    "subtitle": "placeholder subtitle",
    "description_hint": "placeholder description hint",
}
PLACEHOLDER_USAGE = {"prompt_eval_count": 1, "eval_count": 1}
PLACEHOLDER_PNG = (
    "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAQAAAC1HAwCAAAAC0lEQVR42mNkYAAAAAYAAjCB0C8AAAAASUVORK5CYII="
)


def asks_for_listings(user: Column, schema_hint: str = "concept") -> Column:
    return F.lit("listing" in schema_hint) | F.contains(F.lower(user), F.lit("listings"))


def placeholder_completion(df: DataFrame, user: str = "user", schema_hint: str = "concept") -> DataFrame:
    """Offline replies as column expressions, in the shape of ``complete_batch``."""
    content = F.when(
        asks_for_listings(F.col(user), schema_hint), F.lit(json.dumps(PLACEHOLDER_LISTINGS))
    ).otherwise(F.lit(json.dumps(PLACEHOLDER_CONCEPT)))
    return df.withColumns(
        {
            "content": content,
            "raw": F.lit(json.dumps(PLACEHOLDER_USAGE)),
            "call_error": F.lit(None).cast("string"),
        }
    )


def estimate_cost(raw: Column) -> Column:
    """Prompt and reply tokens at the fixed price; absent counts are zero, fractions are cut off."""

    def tokens(key: str) -> Column:
        number = F.get_json_object(raw, f"$.{key}").try_cast("double")
        return F.coalesce(number.cast("bigint"), F.lit(0))

    return (tokens("prompt_eval_count") + tokens("eval_count")) * F.lit(TOKEN_COST)


def _parse(df: DataFrame, content: str, keys: Sequence[str], typed: Callable[[dict[str, Column]], dict[str, C.Field]]) -> DataFrame:
    """Strict parse, one look at each key, then values and the first thing wrong; each step once per row."""
    text = C.once(df, _text=strip_json_fence(F.col(content)))
    doc = C.once(text, _doc=C.strict_json(F.col("_text")))
    members = C.once(doc, **{f"_{k}": C.member(F.col("_doc"), k) for k in keys}, _shape=C.is_object(F.col("_doc")))
    fields = typed({k: F.col(f"_{k}") for k in keys})
    problem = F.coalesce(
        F.when(F.col(content).isNull(), F.lit("no reply")),
        F.when(F.col("_doc").isNull(), F.lit("ParseError: invalid json")),
        F.when(~F.col("_shape"), F.lit("ValidationError: not an object")),
        *[F.when(~F.coalesce(f.ok, F.lit(False)), F.lit(f"ValidationError: {n}")) for n, f in fields.items()],
    )
    made = C.once(members, **{n: f.value for n, f in fields.items()}, parse_error=problem)
    return made.drop("_text", "_doc", "_shape", *[f"_{k}" for k in keys])


def parse_concept(df: DataFrame, content: str = "content") -> DataFrame:
    """Concept reply: pages (array of objects), titles, subtitle, description_hint, parse_error."""

    def typed(v: dict[str, Column]) -> dict[str, C.Field]:
        return {
            "pages": C.object_list_field(v["pages"]),
            "titles": C.text_map_field(v["titles"], F.expr("cast(map() as map<string,string>)")),
            "subtitle": C.text_field(v["subtitle"], F.lit("")),
            "description_hint": C.text_field(v["description_hint"], F.lit("")),
        }

    return _parse(df, content, ["pages", "titles", "subtitle", "description_hint"], typed)


def parse_listings(df: DataFrame, content: str = "content") -> DataFrame:
    """Listing reply: listings (array of objects) and parse_error."""
    return _parse(df, content, ["listings"], lambda v: {"listings": C.object_list_field(v["listings"])})


def first_valid_attempt(
    attempts: DataFrame,
    keys: Sequence[str] = ("product_id",),
    attempt: str = "attempt",
    valid: Column | None = None,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """The first usable reply per key among the allowed attempts, picked on the mappers first."""
    ok = F.col("parse_error").isNull() if valid is None else valid
    rest = [c for c in attempts.columns if c not in keys]
    usable = attempts.filter(ok & (F.col(attempt) <= F.lit(max_attempts)))
    first = usable.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(attempt)).alias("_first"))
    return first.select(*keys, "_first.*").select(*attempts.columns)


def retry_parse(
    prompts: DataFrame,
    complete: Callable[[DataFrame], DataFrame],
    parse: Callable[[DataFrame], DataFrame],
    path: str,
    keys: Sequence[str] = ("product_id",),
    repair: str = REPAIR_SYSTEM,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two rounds of calls: all rows, then the unusable replies with a repaired system message.

    Returns the accepted replies, the rows that stay unusable with their error, and the cost per key.
    Each round is written before it is read: calls are paid and differ from one execution to the
    next. Replies that an interrupted execution has left under ``path`` are used again where key and
    prompt are the same; only the others are asked for. A failed call is final, only an unusable reply
    is repaired. A lost task calls again for its own rows (at least once).
    """
    keys = list(keys)

    def asked(rows: DataFrame, attempt: int) -> DataFrame:
        folder, same = f"{path}/attempt={attempt}", [*keys, "prompt_hash"]
        rows = rows.withColumn("prompt_hash", F.sha2(F.to_json(F.struct("system", "user")), 256))
        replies = settle_missing(rows, folder, same, lambda todo: parse(complete(todo.withColumn("attempt", F.lit(attempt)))))
        return replies.join(rows.select(*same), same, "left_semi")

    one = asked(prompts, 1)
    again = one.filter(F.col("call_error").isNull() & F.col("parse_error").isNotNull()).select(
        *[c for c in prompts.columns if c != "system"],
        fill(repair, error=F.col("parse_error")).alias("system"),
    )
    two = asked(again.select(*prompts.columns), 2)
    accepted = one.filter(F.col("parse_error").isNull()).unionByName(two.filter(F.col("parse_error").isNull()))
    failed = one.filter(F.col("call_error").isNotNull()).unionByName(two.filter(F.col("parse_error").isNotNull()))
    replies = one.select(*keys, "raw").unionByName(two.select(*keys, "raw"))
    cost = replies.groupBy(*keys).agg(F.sum(estimate_cost(F.col("raw"))).alias("cost"))
    return (
        accepted,
        failed.select(*keys, F.coalesce("call_error", "parse_error").alias("error")),
        cost,
    )


def generate_images(
    df: DataFrame, provider: Callable[[], ImageProvider], parallelism: int | None = None, held_bytes: int = 1 << 25
) -> DataFrame:
    """One image per row of (…, prompt, aspect_ratio, size, quality); adds content and call_error.

    A task holds about ``held_bytes`` of images at a time; ``parallelism`` sets the number of concurrent
    clients.
    """
    df = df if parallelism is None else df.repartition(parallelism)
    added = [T.StructField("content", T.BinaryType()), T.StructField("call_error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *added])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = provider()
        for batch in batches:
            images, errors, start, held = [], [], 0, 0

            def full(start: int) -> pd.DataFrame:
                part = batch.iloc[start : start + len(images)]  # noqa: B023
                return part.assign(content=pd.Series(images, index=part.index, dtype=object), call_error=errors)  # noqa: B023

            for row in zip(batch["prompt"], batch["aspect_ratio"], batch["size"], batch["quality"]):
                try:
                    images.append(client.generate(*row))
                    errors.append(None)
                except Exception as error:  # one failed call must not fail its task
                    images.append(None)
                    errors.append(repr(error))
                held += len(images[-1] or b"")
                if held >= held_bytes:
                    yield full(start)
                    start, held = start + len(images), 0
                    images, errors = [], []
            if images:
                yield full(start)

    return df.mapInPandas(draw, schema)


def placeholder_images(df: DataFrame) -> DataFrame:
    """The fixed one-pixel image for every row, as a literal."""
    return df.withColumn("content", F.unbase64(F.lit(PLACEHOLDER_PNG))).withColumn(
        "call_error", F.lit(None).cast("string")
    )
