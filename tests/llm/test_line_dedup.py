import re

from helpers import documents, prose, reachable

from catalogloom.llm import line_dedup


def lead(n, depth):
    return 6 if n >= 24 else n // 4 if n // 4 > depth else depth


def brute_templates(line, depth, longest):
    """Every template of a line, as plain tuples."""
    tokens = line.split()
    shown = ["<*>" if re.search(r"[0-9]|@|://|www\\.", t) else t for t in tokens]
    n = len(shown)
    if not n:
        return []
    if set(shown) == {"<*>"}:
        return [("as it stands", *tokens)]
    out = [tuple(shown)]
    for size in range(1, longest + 1):
        for start in range(lead(n, depth), n - size + 1):
            made = shown[:start] + ["<run>"] * size + shown[start + size :]
            if 2 * sum(t not in ("<*>", "<run>") for t in made) >= n:
                out.append(tuple(made))
    return out


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\r\f\v]+", text.lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least_docs=5, depth=2, longest=3):
    """Templates by comparing everything with everything, near copies by exact Jaccard similarities."""
    texts = sorted({t or "" for _, t in rows})
    met = {}
    for k, text in enumerate(texts):
        for line in text.split("\n"):
            for name in brute_templates(line, depth, longest):
                met.setdefault(name, set()).add(k)
    met = {name: held for name, held in met.items() if len(held) >= least_docs}
    leaves = {}
    for k, text in enumerate(texts):
        for line in text.split("\n"):
            if tokens := line.split():
                shown = brute_templates(line, depth, 0)[0]
                head = ["<*>" if re.search(r"[0-9]|@|://|www\.", t) else t for t in tokens[: lead(len(tokens), depth)]]
                leaves.setdefault((len(tokens), *head), set()).add((k, shown))
    mixed = [{k for k, _ in held} for held in leaves.values() if len({shown for _, shown in held}) > 1]
    exact = [held for name, held in met.items() if "<run>" not in name]
    candidates = sorted(set().union(*exact, *(held for held in mixed if len(held) >= least_docs)))
    sets = {k: shingles(texts[k]) for k in candidates}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kin = reachable(candidates, [(a, b) for a in candidates for b in candidates if a < b and near(a, b)])
    recur = {name for name, held in met.items() if len({kin[k] for k in held}) >= least_docs}
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        keep = [x for x in lines if not set(brute_templates(x, depth, longest)) & recur]
        out.append((i, "\n".join(keep) if len(keep) < len(lines) else text, len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


NAMES = "Anna Bela Cora Dina Edda Fina Gina Hana".split()


def corpus():
    base = prose(1, 80)
    rows = [(i, f"{prose(100 + i, 40)}\nPosted on 2024-01-{i:02} by u{i}@x.org\n\n{prose(300 + i, 30)}") for i in range(8)]
    rows += [(20 + i, f"{prose(400 + i, 40)}\nthis long notice was written for {n} and for nobody else at all") for i, n in enumerate(NAMES)]
    rows += [(30 + i, f"{prose(500 + i, 40)}\nWritten by {n} {'Smith Jones Brown'.split()[i % 3]}\nthis long notice was made by {n} {n[::-1]} and for nobody else at all") for i, n in enumerate(NAMES)]
    pairs = [" ".join(f"{w} {NAMES[(i + k) % 8]}{i}x".replace(str(i), "abcdefgh"[i]) for k, w in enumerate("and green or blue but never in the".split())) for i in range(8)]
    rows += [(50 + i, f"{prose(600 + i, 40)}\nthe house was {p}") for i, p in enumerate(pairs)]
    rows += [(40 + i, base + "\n" + "a shared line of one near copy group here" + f"\nend {'abcdefghij'[i]}") for i in range(10)]
    rows += [(160, "only here once"), (61, ""), (62, None), (62, None), (63, "1 2 3\n4 5 6"), (None, prose(5, 20)), (64, prose(6, 9000))]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    found = line_dedup.drop_lines(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found), key=str) == brute(rows)
    assert {r["size"] for r in found} == {2}


def test_what_goes_and_what_stays(spark):
    found = {r["doc_id"]: r for r in line_dedup.drop_lines(documents(spark, corpus())).collect() if r["doc_id"] is not None}
    assert all("Posted on" not in found[i]["text"] and found[i]["n_dropped"] == 1 for i in range(8))  # digits are fields
    assert all("notice" not in found[20 + i]["text"] for i in range(8))  # a name is a field, too
    assert all("Written by" not in found[30 + i]["text"] and "notice" not in found[30 + i]["text"] for i in range(8))  # of two words, too
    assert all("the house was" in found[50 + i]["text"] for i in range(8))  # lines that differ throughout stay
    assert all(found[40 + i]["n_dropped"] == 0 for i in range(10))  # copies alone do not recur
    assert found[160]["text"] == "only here once" and found[61]["text"] == "" and found[62]["text"] is None
    assert found[63]["text"] == "1 2 3\n4 5 6"


def test_a_group_of_near_copies_shields_no_line(spark):
    base, footer = prose(1, 80), "our common footer stands on every page"
    rows = [(i, f"{base}\n{footer}\nend{i}") for i in range(40)] + [(100 + i, f"{prose(100 + i, 40)}\n{footer}") for i in range(5)]
    assert {r["n_dropped"] for r in line_dedup.drop_lines(documents(spark, rows)).collect()} == {1}
    copies = [r for r in rows if r[0] != 104][:43]  # the group and three others: four documents
    assert {r["n_dropped"] for r in line_dedup.drop_lines(documents(spark, copies)).collect()} == {0}


def test_pages_of_much_boilerplate_lose_it(spark):
    shared = "\n".join(f"menu entry {w} leads somewhere else" for w in "a b c d e f g h i j k l m n o p".split())
    rows = [(i, f"{shared}\n{prose(50 + i, 50)}") for i in range(12)]
    assert {r["n_dropped"] for r in line_dedup.drop_lines(documents(spark, rows)).collect()} == {16}


def test_lines_of_fields_alone_recur_as_they_stand(spark):
    rows = [(i, f"{prose(700 + i, 30)}\n+49-30-5550-{i}\nhttps://x.org/licence legal@x.org") for i in range(6)]
    found = line_dedup.drop_lines(documents(spark, rows)).collect()
    assert {r["n_dropped"] for r in found} == {1}
    assert all("licence" not in r["text"] and f"5550-{r['doc_id']}" in r["text"] for r in found)


def test_empty_table(spark):
    assert line_dedup.drop_lines(documents(spark, [])).collect() == []
