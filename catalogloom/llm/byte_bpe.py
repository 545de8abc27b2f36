"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The pre-tokeniser is a small automaton over codepoint classes. What the pattern looks ahead for (the
last white space of a run, the letters of a contraction) is folded into the symbol of a codepoint, so
each symbol is a function from state to state. Functions compose, and composing is associative:
a blocked scan gives the state before every codepoint of a whole batch without a regular expression.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Arrow, by_bytes, kept, text_of

# Codepoint classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# White space as the pattern's \s has it (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters that make a contraction after an apostrophe (fixed values).
ONE_LETTER, TWO_LETTERS = "stmd", ["re", "ve", "ll"]

# Symbols: a codepoint's class with what follows taken in.
_L, _N, _O, _APOS1, _APOS2, _SPACE_LAST, _SPACE_IN, _WHITE_LAST, _WHITE_IN = range(9)
# States: what the codepoint before belongs to.
_START, _LETTERS, _NUMBERS, _OTHERS, _JOINER, _RUN, _CLOSED, _NEED1, _NEED2, _DONE = range(10)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and cut[symbol, state]: does a piece begin at this codepoint?"""
    step, cut = np.zeros((9, 10), np.uint8), np.ones((9, 10), bool)
    for symbol, own in ((_L, _LETTERS), (_N, _NUMBERS), (_O, _OTHERS)):
        step[symbol] = own
        cut[symbol, [own, _JOINER]] = False
    for need, then in ((_NEED1, _DONE), (_NEED2, _NEED1)):
        step[_L, need], cut[_L, need] = then, False
    for symbol, need in ((_APOS1, _NEED1), (_APOS2, _NEED2)):
        step[symbol] = need
        step[symbol, [_OTHERS, _JOINER]], cut[symbol, [_OTHERS, _JOINER]] = _OTHERS, False
    step[_SPACE_LAST], step[_WHITE_LAST] = _JOINER, _CLOSED
    for symbol in (_SPACE_IN, _WHITE_IN):
        step[symbol], cut[symbol, _RUN] = _RUN, False
    return step, cut


def _classes() -> np.ndarray:
    def make() -> np.ndarray:
        out = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))[0]
            if kind in "LN":
                out[code] = LETTER if kind == "L" else NUMBER
        out[WHITE_SPACE] = WHITE
        out[32] = SPACE
        return out

    return kept("codepoint classes", make)


def _scan(functions: np.ndarray, start: int = _START, width: int = 32) -> np.ndarray:
    """The running composition of ``functions`` (n, states), applied to the state ``start``: (n,)."""
    n, states = functions.shape
    if n <= width:
        out, state = np.empty(n, np.uint8), start
        for i in range(n):
            state = out[i] = functions[i, state]
        return out
    blocks = -(-n // width)
    padded = np.tile(np.arange(states, dtype=np.uint8), (blocks * width, 1))
    padded[:n] = functions
    padded = padded.reshape(blocks, width, states)
    for j in range(1, width):
        padded[:, j] = np.take_along_axis(padded[:, j], padded[:, j - 1].astype(np.intp), axis=1)
    carry = np.concatenate([[start], _scan(np.ascontiguousarray(padded[:, -1]), start, width)[:-1]]).astype(np.intp)
    return np.take_along_axis(padded, carry[:, None, None], axis=2).reshape(-1)[:n]


def piece_starts(codes: np.ndarray, first: np.ndarray, strip: int = 1 << 17) -> np.ndarray:
    """True where a piece begins in ``codes``, texts laid end to end; ``first`` marks their beginnings.

    Codepoints are scanned in strips: the state goes from one to the next, and a strip sees the two
    codepoints after it. A text of any length takes a byte per codepoint beside one strip.
    """
    out, state = np.zeros(len(codes), bool), _START
    for low in range(0, len(codes), strip):
        out[low : low + strip], state = _strip_starts(codes[low : low + strip + 2], first[low : low + strip + 2], strip, state)
    return out


def _strip_starts(codes: np.ndarray, first: np.ndarray, strip: int, state: int) -> tuple[np.ndarray, int]:
    """``piece_starts`` of the leading ``strip`` codes, and the state after them."""
    m = len(codes)
    n = min(m, strip)
    kind = _classes()[codes]
    ahead = np.zeros((2, m), np.uint32)  # the next two codepoints of the same text, else 0
    follows = np.zeros(m, bool)  # the next codepoint of the same text is no white space
    inner = ~first[1:]
    ahead[0, :-1] = np.where(inner, codes[1:], 0)
    ahead[1, :-2] = np.where(inner[:-1] & inner[1:], codes[2:], 0)
    follows[:-1] = inner & (kind[1:] < SPACE)
    kind, ahead, follows, codes, first = kind[:n], ahead[:, :n], follows[:n], codes[:n], first[:n]
    symbol = np.choose(kind, [_L, _N, _O, _SPACE_IN, _WHITE_IN]).astype(np.uint8)
    symbol[(kind == SPACE) & follows] = _SPACE_LAST
    symbol[(kind == WHITE) & follows] = _WHITE_LAST
    at = np.flatnonzero(codes == ord("'"))
    one, two = ahead[:, at]
    symbol[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = _APOS1
    pairs = one.astype(np.uint64) << np.uint64(32) | two
    symbol[at[np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in TWO_LETTERS], np.uint64))]] = _APOS2
    step, cut = _automaton()
    functions = step[symbol]
    functions[first] = step[symbol[first], _START][:, None]
    after = _scan(functions, state)
    before = np.concatenate([[state], after[:-1]]).astype(np.uint8)
    return cut[symbol, before] | first, int(after[-1])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the neighbouring pair of lowest rank joins first, the leftmost of equals."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    if n <= 48:
        return _merge_short(piece, ranks)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, end = heapq.heappop(heap)
        j = ends[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the two has been joined since
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tuple(out)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As ``merge``, with a scan for the lowest pair in place of the heap."""
    none = 1 << 40
    get = ranks.get
    edges = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while (low := min(pairs)) != none:
        i = pairs.index(low)
        del edges[i + 1]
        del pairs[i]
        if i:
            pairs[i - 1] = get(piece[edges[i - 1] : edges[i + 1]], none)
        if i < len(pairs):
            pairs[i] = get(piece[edges[i] : edges[i + 2]], none)
        if not pairs:
            break
    return tuple(ranks[piece[a:b]] for a, b in zip(edges, edges[1:]))


def load_ranks(path: str) -> dict[bytes, int]:
    def make() -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    return kept(("ranks", path), make)


def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes end to end, where each id's begin, and their lengths."""

    def make():
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        sizes = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    return kept(("vocabulary", path), make)


def encode_texts(texts: list[str], ranks: dict[bytes, int], cache: dict, most_cached: int = 1 << 19) -> list[list[int]]:
    """Ids of each text. ``cache`` holds pieces already merged; it is emptied when full."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    starts = np.flatnonzero(piece_starts(codes, first))
    bounds = [*starts.tolist(), len(codes)]
    until = np.searchsorted(starts, np.cumsum(lengths)).tolist()
    out, k = [], 0
    for end in until:
        ids: list[int] = []
        for i in range(k, end):
            piece = joined[bounds[i] : bounds[i + 1]]
            found = cache.get(piece)
            if found is None:
                if len(cache) >= most_cached:
                    cache.clear()
                found = cache[piece] = merge(piece.encode(), ranks)
            ids += found
        out.append(ids)
        k = end
    return out


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 18) -> DataFrame:
    """(id, ids array<int>, ends array<long>) of every row: token ids and where each ends in the bytes.

    Pieces are those of the rank files' pattern; no special tokens, as ``encode_ordinary`` of tiktoken.
    Null text counts as empty and gives empty arrays. A null id is passed on, repeated rows give
    repeated rows, an empty table gives an empty one; other columns are not read. A text is encoded
    whole, whatever its length; short ones share a batch of about ``batch_chars`` characters.
    """

    def run(batches: Arrow) -> Arrow:
        ranks, cache = load_ranks(ranks_path), kept(("pieces", ranks_path), dict)
        sizes = _vocabulary(ranks_path)[2]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in by_bytes(texts, batch_chars):
                found = encode_texts(texts[start:end], ranks, cache)
                counts = np.array([len(x) for x in found], np.int64)
                flat = np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))
                total = np.concatenate([[0], np.cumsum(sizes[flat])])
                edge = np.concatenate([[0], np.cumsum(counts)])
                ends = total[1:] - np.repeat(total[edge[:-1]], counts)
                edge = pa.array(edge.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.ListArray.from_arrays(edge, pa.array(flat)),
                        pa.ListArray.from_arrays(edge, pa.array(ends.astype(np.int64))),
                    ],
                    ["id", "ids", "ends"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, ends array<long>").withColumnRenamed("id", id_col)


def _placed(ids: np.ndarray, ends: np.ndarray, vocabulary: tuple, strip: int = 1 << 16) -> np.ndarray:
    """The bytes of ``ids``, each put before its end; a strip of ids at a time."""
    blob, begins, sizes = vocabulary
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for low in range(0, len(ids), strip):
        part, end = ids[low : low + strip], ends[low : low + strip]
        size = sizes[part]
        start, stop = int(end[0] - size[0]), int(end[-1])
        out[start:stop] = blob[np.repeat(begins[part] - (end - size), size) + np.arange(start, stop)]
    return out


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", batch_bytes: int = 1 << 22) -> DataFrame:
    """(id, ids, decoded binary): the bytes of ``ids``, put in place by their ``ends``.

    Rows of about ``batch_bytes`` are decoded at once, a longer one alone. Null ids count as none and give
    no bytes.
    """

    def run(batches: Arrow) -> Arrow:
        vocabulary = _vocabulary(ranks_path)
        for batch in batches:
            ids, ends = batch.column(1), batch.column(2)
            edge = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))]).astype(np.int64)
            flat, last = ids.flatten().to_numpy(), ends.flatten().to_numpy()
            size = np.where(np.diff(edge) > 0, last[np.maximum(edge[1:], 1) - 1] if len(last) else 0, 0).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(total, total[row] + batch_bytes, side="right")) - 1)
                own = slice(int(edge[row]), int(edge[stop]))
                # Ends count from the beginning of the row; the rows follow one another.
                shift = np.repeat(total[row:stop] - total[row], np.diff(edge[row : stop + 1]))
                data = _placed(flat[own], last[own] + shift, vocabulary)
                offsets = pa.py_buffer((total[row : stop + 1] - total[row]).astype(np.int32).tobytes())
                decoded = pa.Array.from_buffers(pa.binary(), stop - row, [None, offsets, pa.py_buffer(data)])
                some = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), decoded], ["id", "ids", "decoded"])
                row = stop

    rows = encoded.select(
        F.col(id_col).alias("id"),
        F.coalesce("ids", F.array().cast("array<int>")).alias("ids"),
        F.coalesce("ends", F.array().cast("array<long>")).alias("ends"),
    )
    return rows.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
