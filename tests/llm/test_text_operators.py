"""Text operators against plain loops, and on odd rows."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, html, language, license, lines, mixing, quality, simhash, topk, warc
from tracelake.llm.common import LOWER


def words(text):
    return (text or "").encode().translate(LOWER).split()


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


# mixing


def test_mix_meets_targets(sample):
    out = mixing.mix(sample("documents")).join(sample("documents").select("doc_id", "source"), "doc_id").toPandas()
    assert len(out) == sample("documents").count()
    assert (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert by["target"].sum() == pytest.approx(by["size"].sum())
    assert (by["target"] <= 3 * by["size"] + 1e-9).all()
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 1).all()


def test_mix_shares_excess_again(spark):
    # the first source may take three times its 10 words only; the others share the rest 2 to 1
    docs = spark.createDataFrame([(1, "a", "w " * 10), (2, "b", "w " * 400), (3, "c", "w " * 400)], "doc_id long, source string, text string")
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert out[1]["target"] == 30 and out[1]["taken"] == 30
    assert out[2]["target"] == pytest.approx(780 * 2 / 3) and out[3]["target"] == pytest.approx(780 / 3)


def test_mix_reaches_targets_of_tiny_sources(spark):
    rows = [(i, "big" if i % 2 else "large", "w " * 20_000) for i in range(100)] + [(200, "tiny", "w " * 10), (201, "wee", "w " * 6), (202, "xs", "w")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    names = {r[0]: r[1] for r in rows}
    by = out.assign(source=out["doc_id"].map(names)).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 1).all() and (out["taken"] <= 3 * out["size"]).all()
    assert by.loc["tiny", "taken"] == 30 and by.loc["wee", "taken"] == 18 and by.loc["xs", "taken"] == 3


def test_mix_odd_rows(odd_docs, no_docs):
    first, again = (sorted(map(str, mixing.mix(odd_docs).collect())) for _ in range(2))
    assert first == again and len(first) == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0


# SimHash


def test_fingerprint_is_the_bit_majority():
    import xxhash

    text = "One two THREE four  one two"
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == 0 and simhash.fingerprint(None) == 0
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_near_duplicates_match_all_pairs(sample):
    docs = sample("documents")
    rows = docs.select("doc_id", "text").collect()
    prints = np.array([simhash.fingerprint(r["text"]) for r in rows], np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    root = groups(len(rows), pairs)
    smallest = {}
    for r, g in zip(rows, root, strict=True):
        smallest[g] = min(r["doc_id"], smallest.get(g, r["doc_id"]))
    want = {(r["doc_id"], f"{int(p):016x}", smallest[g]) for r, p, g in zip(rows, prints, root, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want


def test_links_of_dense_and_hot_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(4)]
    # thousands around one value: long runs, and runs beyond what a task holds
    dense = {int(base[0]) ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(30) for j in range(30) for k in range(12)}
    prints = np.array(sorted({*near, *dense}), np.uint64)
    df = spark.createDataFrame([(0, int(p)) for p in prints.view(np.int64)], "space long, fp long")
    at = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    got = groups(len(prints), [(at[r["a"]], at[r["b"]]) for r in simhash.fingerprint_links(df).collect()])
    links = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    want = groups(len(prints), links)
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(want)) == len(set(got))


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {2}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group(spark, odd_docs, no_docs):
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    texts = [r["text"] for r in odd_docs.collect()]
    assert set(got.values()) == {1}
    assert len(got) == len({tuple(words(t)) for t in texts})
    assert simhash.one_of_each_group(no_docs).count() == 0
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base)), (1000, " ".join(f"v{x}" for x in range(300)))]
    for i in range(1, 120):
        copy = list(base)
        for at in rng.integers(0, 300, 5):
            copy[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    left = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0, 1000}


def test_one_of_each_group_is_exact_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(12):  # a tenth of the words replaced or added at one end
        base = [f"g{k}w{x}" for x in range(40 + 10 * k)]
        cut = len(base) // 10
        texts += [base, base[cut:], base + [f"g{k}n{x}" for x in range(cut)], [f"g{k}m{x}" for x in range(cut)] + base[cut:]]
    for k in range(3):  # groups over the same set of words, in other orders
        bag = [f"s{x}" for x in range(60)]
        for _ in range(20):
            rng.shuffle(bag)
            texts += [list(bag), [*bag[2:], *bag[:2]]]
    texts = [" ".join(t) for t in texts]
    shingles = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in map(words, texts)]
    near = [(i, j) for j, b in enumerate(shingles) for i, a in enumerate(shingles[:j]) if len(a & b) >= 0.8 * len(a | b)]
    want = {min(j for j, g in enumerate(found) if g == r) for found in [groups(len(texts), near)] for r in found}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == want


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    rng, tried, verify = np.random.default_rng(3), [], simhash._verified
    base = [f"w{x}" for x in rng.integers(0, 9000, 400)]
    texts = [base, [*base, "more"], base[40:], [f"v{x}" for x in range(90)]]  # the third shares 0.9: beyond the radius
    prints = [simhash.bit_majority(simhash._shingles(" ".join(t))[1]) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < min((prints[2] ^ p).bit_count() for p in prints[:2])

    def verified(candidates, nodes, plain, threshold):
        docs = {r["num"]: r["doc"] for r in nodes.collect()}
        tried.append({frozenset((docs[r["x"]], docs[r["y"]])) for r in candidates.collect()})
        return verify(candidates, nodes, plain, threshold)

    monkeypatch.setattr(simhash, "_verified", verified)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == {0, 3}
    # the exact way goes on with what fingerprints left apart
    assert tried[0] == {frozenset((0, 1))} and not any(frozenset((0, 1)) in t for t in tried[1:])
    assert tried[1] and tried[1] <= {frozenset((0, 2)), frozenset((1, 2))}


@pytest.mark.parametrize("n, m", [(1, 1), (3, 900), (200, 260), (5000, 4600), (0, 4)])
def test_parity_maps_never_differ_by_more_than_the_sets(n, m):
    rng = np.random.default_rng(n)
    for shared in {0, min(n, m) // 2, min(n, m)}:
        both = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = both[:n], np.concatenate([both[:shared], both[n:n + m - shared]])
        total = simhash._close(0.8).func(*(__import__("pandas").Series([x]) for x in (simhash.parity(a), simhash.parity(b), len(a), len(b))))
        reaches = 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
        assert total[0] or not reaches


# lines


def brute_lines(docs):
    first, occurrences = {}, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        for k, line in enumerate((r["text"] or "").split("\n")):
            tokens = frozenset(words(line))
            if tokens:
                occurrences.append(((r["doc_id"], k), tokens))
                first.setdefault(tokens, (r["doc_id"], k))
    known = list(first)
    matched = {y for y in known for x in known
               if first[x] < first[y] and 5 * len(x & y) >= 4 * len(x | y)}
    return {place for place, tokens in occurrences if first[tokens] != place or tokens in matched}


def test_repeated_lines_match_all_pairs(sample, spark):
    docs = sample("documents")
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()}
    assert got == brute_lines(docs.collect())
    rng = np.random.default_rng(3)
    made = []
    for i in range(150):
        base = [f"t{x}" for x in range(rng.integers(1, 30))]
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(len(base))] = f"o{rng.integers(40)}"
        made.append((i, "\n".join([" ".join(base), f"line {i}"])))
    made = spark.createDataFrame(made, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(made).collect()} == brute_lines(made.collect())


def test_repeated_lines_of_four_to_eight_words(spark):
    # sets of four and five tokens meet on pairs, longer ones on triples
    rng = np.random.default_rng(5)
    made = [(i, "\n".join(" ".join(rng.choice([f"w{x}" for x in range(11)], rng.integers(3, 9), replace=False)) for _ in range(3))) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()} == brute_lines(docs.collect())


def brute_links(docs, threshold=0.8):
    """Per line to remove: the most similar earlier line, the similarity and the number of earlier sets of words that match."""
    first, occurrences = {}, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        for k, line in enumerate((r["text"] or "").split("\n")):
            tokens = frozenset(words(line))
            if tokens:
                occurrences.append(((r["doc_id"], k), tokens))
                first.setdefault(tokens, (r["doc_id"], k))
    found = {}
    for place, tokens in occurrences:
        links = [(-len(tokens & x) / len(tokens | x), at) for x, at in first.items() if at < first[tokens] and len(tokens & x) >= threshold * len(tokens | x)]
        if first[tokens] != place:
            found[place] = (*first[tokens], 1.0, len(links))
        elif links:
            found[place] = (*min(links)[1], -min(links)[0], len(links))
    return found


@pytest.mark.parametrize("pairs", [100, 1 << 20])
def test_repeated_lines_count_every_link(sample, spark, pairs, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", pairs)  # verified in parts, or all at once
    rare, often = [f"r{i}" for i in range(16)], [f"f{i}" for i in range(4)]
    # all keys of the third line begin at the first line, but the second one is more similar
    variants = [[*rare, *often], [*rare, *often[:3]], [*rare, *often[:2]], [*rare, *often[:2]]]
    rng = np.random.default_rng(8)
    made = [(i, " ".join(v)) for i, v in enumerate(variants)] + [(10 + i, " ".join([*often, f"other{i}"])) for i in range(9)]
    made += [(100 + i, " ".join(rng.choice([f"t{x}" for x in range(14)], rng.integers(9, 13), replace=False))) for i in range(80)]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (made, sample("documents")) if pairs > 100 else (made,):
        want = brute_links(docs.collect())
        got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"], r["jaccard"], r["links"]) for r in lines.repeated_lines(docs).collect()}
        assert got.keys() == want.keys()
        assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
        assert all(abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    assert brute_links(made.collect())[2, 0] == (1, 0, 18 / 19, 2) and max(v[3] for v in brute_links(made.collect()).values()) > 5


def test_rarity_is_short_in_plans(spark):
    # each of 60,000 words four times: most buckets are of one class, which is not zero
    rows = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60000), x -> concat('w', x)), ' ')").alias("text"))
    split = lines._lines(rows)
    plan = lines._signed(split, lines._rarity(split))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 4 * lines.BUCKETS


def test_lines_meet_on_few_keys(spark):
    # no two of these lines match, though any two share single words and many share pairs
    rng = np.random.default_rng(6)
    words_used = [f"w{x}" for x in range(100)]
    texts = [" ".join(rng.choice(words_used, 12, replace=False)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lines._lines(docs)
    keys = [set(r["keys"]) for r in lines._signed(split, lines._rarity(split)).collect()]
    met = sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i])
    assert met < 0.01 * len(keys) * (len(keys) - 1) / 2
    assert lines.repeated_lines(docs).count() == len(brute_lines(docs.collect()))


def test_ranked_tokens_sort_as_plain_numbers(spark):
    # tokens that might be null would be sorted as objects, with a comparison of boxed numbers each
    texts = ["Zwei\tWörter  und\rnoch\v\fmehr ", " \t ", "zwei wörter und noch mehr", "ÄB ab äb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lines._lines(docs)
    assert all(not set("\t\v\f\r") & set(r["line"]) for r in split.collect())
    signed = lines._signed(split, lines._rarity(split))
    assert not signed.schema["keys"].dataType.containsNull
    rows = {r["doc"]: r for r in signed.collect()}
    assert sorted(rows) == [0, 2, 3] and [rows[i]["n"] for i in (0, 2, 3)] == [5, 5, 3]
    assert rows[0]["cls"] == rows[2]["cls"] and rows[0]["keys"] == rows[2]["keys"]


def test_remove_repeated_lines_odd_rows(odd_docs, no_docs):
    out = lines.remove_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {(r["doc_id"], r["lang"]): r["text"] for r in out.collect()}
    assert by[(0, None)] == odd_docs.where("doc_id = 0").first()["text"]
    assert by[(2, None)] is None and by[(3, "en")] == ""
    assert lines.remove_repeated_lines(no_docs).count() == 0


def test_rows_without_an_id_of_their_own_keep_clean_lines(spark):
    once, clean = "one two three four five six seven", "a line that nobody else has at all"
    rows = [(None, f"{once}\n{clean} 1"), (None, f"{clean[::-1]}\nx y z"), (7, once), (7, "p q r s"), (None, f"{once} eight"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] or "" for r in lines.remove_repeated_lines(docs).collect()) == sorted(["", "", f"{clean} 1", rows[1][1], once, "p q r s"])
    items = spark.createDataFrame([(1, once)], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(["", rows[1][1], "p q r s"])


# decontamination


def test_contaminated_matches_all_windows(sample):
    docs, items = sample("documents"), sample("benchmark")

    def bag(w):
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))

    item_words = {r["item_id"]: words(r["text"]) for r in items.collect()}
    places = defaultdict(list)
    for i, w in item_words.items():
        for k in range(max(1, len(w) - 4)):
            places[tuple(w[k:k + 5])].append((i, k))
    want = {}
    for r in docs.collect():
        w = words(r["text"])
        for i, start in {(i, max(0, p - k)) for p in range(len(w) - 4) for i, k in places.get(tuple(w[p:p + 5]), ())}:
            a, b = bag(w[start:start + len(item_words[i])]), bag(item_words[i])
            similarity = sum((a & b).values()) / sum((a | b).values())
            if similarity >= 0.8:
                want[(r["doc_id"], i)] = max(similarity, want.get((r["doc_id"], i), 0))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == pytest.approx(want) and want


def test_contaminated_finds_every_full_window(spark):
    rng = np.random.default_rng(2)
    items, docs = [], []
    for i in range(60):
        item = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(22, 120))]
        cut, mid = len(item) // 11, len(item) // 2
        added = [f"a{x}" for x in rng.integers(0, 3000, cut)]
        around = [[f"r{x}" for x in rng.integers(0, 3000, 150)] for _ in range(2)]
        copies = [[*added, *item[cut:]], [*item[:len(item) - cut], *added], [*added[:cut // 2], *item[cut // 2:mid], *added, *item[mid:-1], "x"]]
        items.append((i, " ".join(item)))
        docs += [(3 * i + k, " ".join([*around[0], *copy, *around[1]])) for k, copy in enumerate(copies)]

    def bag(w):
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))

    want = {}
    for d, text in docs:
        w, (i, item) = words(text), items[d // 3]
        b = bag(words(item))
        size = sum(b.values()) + 4
        best = max(sum((bag(w[s:s + size]) & b).values()) for s in range(len(w) - size + 1))
        if best >= 0.8 * (2 * size - 8 - best):
            want[(d, i)] = best / (2 * size - 8 - best)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == pytest.approx(want) and len(want) > 100


def test_passages_beyond_the_radius_are_met_too(spark):
    # a tenth of the words changed at one end: some fingerprints differ by more than the radius, all are found
    rng = np.random.default_rng(8)
    items = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(80)]
    docs = [[*item[5:], *[f"n{x}" for x in rng.integers(0, 500, 5)]] for item in items]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    by_radius = {
        radius: {(r["doc"], r["item"], r["start"], r["similarity"]) for r in decontaminate._contaminated(frame(docs, "doc_id"), frame(items, "item_id"), 0.8, radius).collect()}
        for radius in (1, 12, 31)}
    assert len(by_radius[12]) == 80 and by_radius[1] == by_radius[12] == by_radius[31]


def test_contaminated_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick BROWN fox jumps over the lazy dog"), (None, "café"), (3, None), (4, ""), (5, "word")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_docs, items).collect()}
    assert got == {(0, 1), (1, 1), (None, 1), (7, None), (5, 5)}
    clean = decontaminate.without_contaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns
    # of the rows that share id 1 or have none, those without a passage stay
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 8, None]))
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


# quality and language


def test_statistics_look_at_distinct_characters_only(monkeypatch):
    looked = []

    class Vowels:
        """Tells how many characters are looked at, one by one or in a text."""

        def match(self, text):
            looked.extend(text)
            return text.lower() in "aeiouä" or None

        def findall(self, text):
            return [c for c in text if self.match(c)]

    monkeypatch.setattr(quality, "_VOWELS", Vowels())
    line = "Ähm, THE 12 cats & 3 dogs!\n"
    got = quality.statistics(line * 500)
    assert len(looked) <= len(set(line))
    letters, n = 14 * 500, len(line) * 500
    assert got[6:10] == pytest.approx([letters / n, 4 / 14, 1500 / n, 1500 / n]) and got[21] == pytest.approx(4 / 14)
    assert got[16] == pytest.approx(1 / 7) and got[19] == pytest.approx(2 / 7) and got[20] == pytest.approx(1 / 7) and got[23] == pytest.approx(3 / 7)


def test_quality_on_held_out_documents(sample, odd_docs, no_docs, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95 and out["score"].between(0, 1).all()
    marks = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (5, None, 0), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(odd_docs, marks).count() == odd_docs.count()
    assert {r["score"] for r in quality.quality(odd_docs, marks.limit(0)).collect()} == {0.5}
    assert quality.of_quality(no_docs, marks).columns == odd_docs.columns


def test_language_on_held_out_documents(sample, odd_docs, no_docs):
    docs = sample("documents")
    out = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()
    by = {r["doc_id"]: r["lang_pred"] for r in language.languages(odd_docs).where("doc_id is not null and doc_id <> 1").collect()}
    assert by[2] == by[3] == by[4] == by[6] == "und" and by[0] != "und"
    assert language.languages(no_docs).count() == 0


# pages


def plain_language(taught, text):
    """The prediction by loops over words, without memory of any."""
    import math
    import re

    def words_of(t):
        return re.findall("[^\\W\\d_]+", "".join(c if c.isalpha() or not c.isalnum() else " " for c in t.lower()).replace("_", " "))

    langs = sorted(taught)
    counts = [{lang: Counter() for lang in langs} for _ in range(5)]
    for lang, texts in taught.items():
        for word in (w for t in texts for w in words_of(t)):
            counts[0][lang][word] += 1
            for size in range(1, 5):
                padded = f"<{word}>"
                counts[size][lang].update(padded[i:i + size] for i in range(len(padded) - size + 1))
    base = [{lang: sum(c.values()) + 0.5 * len(c) for lang, c in by.items()} for by in counts]
    logs = lambda size, piece: [math.log((counts[size][lang][piece] + 0.5) / base[size][lang]) for lang in langs]
    known = lambda size, piece: any(piece in c for c in counts[size].values())
    words_, total = words_of(text or ""), np.zeros(len(langs))
    if not words_:
        return "und"
    for word in words_:
        if known(0, word):
            total += logs(0, word)
            continue
        padded = f"<{word}>"
        sizes = [next((n for n in range(min(4, len(padded) - i), 0, -1) if known(n, padded[i:i + n])), 0) for i in range(len(padded))]
        found = [logs(n, padded[i:i + n]) for i, n in enumerate(sizes) if n]
        total += np.mean(found, axis=0) if found else 0
    return langs[int(np.argmax(total / math.sqrt(len(words_))))]


def test_language_matches_plain_loops(spark, sample):
    rows = sample("documents").limit(60).collect()
    taught = defaultdict(list)
    for r in rows[:40]:
        if r["lang"] and r["text"]:
            taught[r["lang"]].append(r["text"])
    model = language.fit(spark.createDataFrame([(lang, t) for lang, ts in taught.items() for t in ts], "lang string, text string"))
    reader = language.Reader(model)
    for text in [r["text"] for r in rows] + ["½ ² Ⅷ ①", "", None, "12 ½x", "zzz qqq", "Ⅷabc", "der the le"]:
        assert reader.predict(text)[0] == plain_language(taught, text), text
    assert reader.predict("½ ² Ⅷ ①") == ("und", 0.0)


def test_counts_and_unknown_words_match_plain_loops():
    counts = language._counts_of({"aa": {"ab-abc": 2, "x": 1, "12": 3}, "bb": {"abcdef": 1}})
    got = {(r.lang, r.size, r.piece): r.n for r in counts.itertuples(index=False)}
    wanted = {}
    for lang, word, n in (("aa", "ab", 2), ("aa", "abc", 2), ("aa", "x", 1), ("bb", "abcdef", 1)):
        wanted[lang, 0, word] = n
        for size in range(1, language.LONGEST + 1):
            for i in range(len(word) + 3 - size):
                gram = (lang, size, f"<{word}>"[i:i + size])
                wanted[gram] = wanted.get(gram, 0) + n
    assert got == wanted
    model = language.Model(["aa", "bb"], {"abc": 0}, {"x": 1, "<": 2, "xy": 3}, np.array([[-1., -2], [-3, -5], [-7, -9], [-11, -13]]))
    reader = language.Reader(model)
    far = "q" * (language._SHORT + 1)
    rows = reader._pieces(["xyx", "abc-x", "12", far])
    assert reader.sums[rows["xyx"]].tolist() == [-21 / 3, -27 / 3, 1]  # < xy x
    assert reader.sums[rows["abc-x"]].tolist() == [-1 - 10 / 2, -2 - 14 / 2, 2] and not reader.sums[rows["12"]].any()
    assert reader.sums[rows[far]].tolist() == [-7, -9, 1] and far not in reader.at and "xyx" in reader.at


def test_small_languages_keep_their_pieces(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 30)
    big = [("aa", " ".join(f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop").replace("w", "q"))] * 50
    model = language.fit(spark.createDataFrame([*big, ("bb", "rare words only here")], "lang string, text string"))
    assert {"rare", "words", "only", "here"} <= set(model.words) and len(model.words) == 34
    assert language.Reader(model).predict("rare words")[0] == "bb"


def test_html_main_text(spark, sample):
    pages = sample("pages")
    model = html.fit(pages)
    got = pages.withColumn("main", html.main_text(F.col("html"), model)).toPandas()
    import re
    right = 0
    for r in got.itertuples():
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        right += "\n\n".join(x for x in parts if x) == r.main
    assert right >= 0.98 * len(got)
    rng, vocabulary = np.random.default_rng(77), [w for t in got["main"][:50] for w in t.split()]
    blocks = wrong = 0
    for _ in range(100):
        page, labels = html.made_page(rng, vocabulary)
        cut = html.blocks_of(page)
        assert len(cut) == len(labels)
        blocks, wrong = blocks + len(cut), wrong + int((model.main([html.vectors(cut)])[0] != np.array(labels, bool)).sum())
    assert wrong <= 0.03 * blocks
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "no tags at all"), (3, "u", "<p" * 50), (4, "u", "<script>x")], "page_id long, url string, html string")
    out = html.extracted(odd).collect()
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extracted(odd.limit(0)).count() == 0


def test_blocks_decode_and_trim():
    cut = html.blocks_of("<body><!-- a > b --><p>one &amp;\n two<br>three<p>four <b>five</b></p><script>var t='</p>';</script><li><a href='>'>six</a></body>")
    assert [(b.text, b.linked) for b in cut] == [("one & two three", 0), ("four five", 0), ("six", 3)]


def test_blocks_keep_what_is_not_markup():
    text = lambda page: [b.text for b in html.blocks_of(page)]
    assert text("<p>Let <math><mi>x</mi></math> be <svg><text>y</text></svg></p>") == ["Let x be y"]
    assert text("a <!--> b <!-- c -> d --> e <![CDATA[ f ]]> g <?php h ?> i") == ["a b e g i"]
    assert text("1 < 2 and <3 and a<b>c</b> <p title='a > b'>d <p title=\"'\">e</p> < / <") == ["1 < 2 and <3 and ac", "d", "e", "< / <"]
    assert text("<title>no</title><style>p{}</style>yes<script>if(a<b)'</p>'</script><template><p>no</template> too<script>rest <p>no") == ["yes too"]
    assert [b.path for b in html.blocks_of("<ul class=x><li>a<li id='i'>b<b>c</ul><p>d")] == [("ul x", "li"), ("ul x", "li i", "b"), ("p",)]


@pytest.mark.parametrize("piece", [
    "<p ", "<script ", "<", "</", "<a href='", '<a href="\'', "<!", "<!--", "<b><p>", "<div>x", "<li><div><b>", "</p>x<p", "<a>x", "&amp", "<aaaa", "<?", "<p '>\"", "<td><p>y<b>", "<title>",
])
def test_broken_pages_take_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    blocks = html.blocks_of(page)
    assert time.process_time() - start < 4, piece  # far from the hours of a quadratic scan, also on a busy machine
    assert html.blocks_of(page + "</script></title>'\"><p>end")[-1:] is not None and isinstance(blocks, list)


def test_warc_round_trip(spark, tmp_path):
    texts = ["a", "a", None, "", "é<p>" * 5000, "x\r\n\r\ny", "a"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, t) for i, t in enumerate(texts)] + [(6, "again", "a"), (None, "n", "a")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    assert warc.write_warc(warc.with_revisits(pages), folder) == 9
    back = warc.read_warc(spark, folder).collect()
    assert Counter(r["record_type"] for r in back) == {"response": 5, "revisit": 4}
    for r in back:
        text = (texts[r["page_id"]] if r["page_id"] is not None else "a") or ""
        assert r["payload_bytes"] == len(text.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        if r["record_type"] == "response":
            assert r["payload"] == text.encode() and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] == {"a": 6, "": 3}[text]
    some = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit' AND page_id IN (0, 2)")
    assert {r["page_id"] for r in some.collect()} == {0, 2}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "page_id#" in plan and "Filter (record_type" not in plan.replace("(isnotnull", "(")
    assert warc.archived(pages.limit(0)).count() == 0 and warc.archived(pages).count() == 9


def test_archives_of_others(spark, tmp_path):
    """Plain gzip members, one member for all records, and unpacked files, with records of every kind."""
    import gzip

    def made(kind, uri, content_type, block, *more):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{kind}>"), ("warc-date", "2024-01-01T00:00:00Z"), *more]
        fields += ([("WARC-Target-URI", uri)] if uri else []) + [("Content-Type", content_type), ("Content-Length", str(len(block)))]
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"

    long = "é".encode() * 1_500_000
    rows = [
        made("warcinfo", None, "application/warc-fields", b"software: x\r\n"),
        made("request", "http://a/", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        made("response", "<http://a/>", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>\r\n\r\nhi", ("X-Folded", "one\r\n two")),
        made("revisit", "http://a/", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n", ("WARC-Payload-Digest", "sha1:ABC")),
        made("resource", "http://b/", "text/plain", long), made("metadata", "http://b/", "text/plain", b""),
    ]
    files = {"members.warc.gz": b"".join(map(gzip.compress, rows)), "whole.warc.gz": gzip.compress(b"".join(rows)), "plain.warc": b"".join(rows)}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = {
        "warcinfo": (None, 13, sha(b"software: x\r\n"), b"software: x\r\n"), "request": ("http://a/", 0, sha(b""), b""),
        "response": ("http://a/", 9, sha(b"<p>\r\n\r\nhi"), b"<p>\r\n\r\nhi"), "revisit": ("http://a/", None, "ABC", None),
        "resource": ("http://b/", len(long), sha(long), long), "metadata": ("http://b/", 0, sha(b""), b"")}
    for name, data in files.items():
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(data)
        got = {r["record_type"]: r for r in warc.read_warc(spark, f"file://{folder}").collect()}
        assert {k: (r["target_uri"], r["payload_bytes"], r["payload_digest"], r["payload"]) for k, r in got.items()} == want
        some = warc.read_warc(spark, f"file://{folder}", payload=False).where("record_type = 'resource'").collect()
        assert [(r["payload_bytes"], r["payload"]) for r in some] == [(len(long), None)]
    broken = tmp_path / "broken"
    broken.mkdir()
    with pytest.raises(Exception, match="within a record|not a record"):
        (broken / "x.warc").write_bytes(rows[4][:-200])
        warc.read_warc(spark, f"file://{broken}").collect()


def test_archived_digests_are_those_of_the_payloads(spark):
    html = "x" * 3_000_000
    big = (1 << 62) + 1
    rows = [(1, "u", html, "s"), (2, "u", html, "s"), (2, "v", "b", "s"), (3, None, None, "s"), (big, "w", "c", "s"), (None, "w", "c", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sum string").withColumns({"first": F.lit(1), "n": F.lit(2)})
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()]
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted(got, key=str) == sorted(
        [(1, len(html), sha(html), "revisit", 2), (2, len(html), sha(html), "response", None), (2, 1, sha("b"), "response", None), (3, 0, sha(""), "response", None),
         (big, 1, sha("c"), "response", None), (None, 1, sha("c"), "revisit", big)], key=str)


# licenses and search


def test_licenses(spark, odd_docs, no_docs):
    rows = [(i, f"some words before\n{text}\nafter", name) for i, (name, text) in enumerate(license.TEMPLATES.items())]
    rows += [(100, "This work is licensed under the GNU General Public License, version 4.", "GPL"), (101, "The license of the dog", None), (102, None, None),
             (103, "x " * 50_000 + "Released under the MIT License.", "MIT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r["doc_id"]: r for r in license.licenses(docs).collect()}
    for i, _, want in rows[:-4]:
        assert got[i]["license"] == license.spdx(want) and got[i]["similarity"] == 1.0 and got[i]["line_no"] == 1
    assert got[100]["license"].startswith("GPL") and "=>" in got[100]["differences"]
    assert got[103]["license"] == "MIT" and 101 not in got and 102 not in got
    assert license.licenses(odd_docs).count() == 0 and license.licenses(no_docs).count() == 0


def test_licenses_match_all_templates_on_all_windows(spark):
    """Notices with words changed, put in, left out, wrapped and side by side, against every window of every template."""
    rng = np.random.default_rng(6)
    scanner, texts = license.Scanner(license.TEMPLATES), []
    for name, text in license.TEMPLATES.items():
        w = text.split()
        for share in (0.0, 0.08, 0.16, 0.3):
            changed = [f"z{rng.integers(99)}" if rng.random() < share else x for x in w]
            texts.append((name, "of the software in this\n" + "\n".join(" ".join(changed[i:i + 7]) for i in range(0, len(changed), 7)) + "\n\nand more of it"))
    for name, text in texts:
        found = license.words(text)
        sure = {}
        for other, target in scanner.words.items():
            best = max((2 * sum(m.size for m in license.SequenceMatcher(None, target, found[a:b], autojunk=False).get_matching_blocks()) / (len(target) + b - a)
                        for a in range(min(9, len(found))) for b in range(max(a + 1, len(found) - 9), len(found) + 1)), default=0) if other == name else 0
            if best >= 0.8:
                sure[license.spdx(other)] = best
        got = {license.spdx(n.name): n.similarity for _, _, n in scanner.notices(text)}
        for lic, similarity in sure.items():
            # another license of nearly the same words may agree with more of them
            assert lic in got and got[lic] >= similarity - 0.02 or any(s >= similarity - 0.02 for s in got.values()), (name, sure, got)
    both = f"{license.TEMPLATES['MIT']} {license.TEMPLATES['MPL-2.0']}"
    assert [(a, license.spdx(n.name)) for a, _, n in scanner.notices(both)] == [(0, "MIT"), (0, "MPL-2.0")]
    permission = license.TEMPLATES["MIT (text)"].replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    big = (1 << 62) + 1
    ids = license.licenses(spark.createDataFrame([(big, both), (None, both)], "doc_id long, text string")).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in ids} == {big, None}
    docs = spark.createDataFrame([(1, f"Copyright me\n\n{permission}\n"), (None, both)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["line_no"], r["last_line"]) for r in license.licenses(docs).collect()}
    last = permission.count("\n") + 2
    assert got == {(1, "MIT", 2, last), (None, "MIT", 0, 0), (None, "MPL-2.0", 0, 0)}


def test_wording_is_aligned_by_the_best_way_of_all():
    def agree(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + (x == y), new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(4)
    for _ in range(150):
        target, found = (rng.choice(list("abcdef"), rng.integers(1, most)).tolist() for most in (9, 14))
        best = max(2 * agree(target, found[i:j]) / (len(target) + j - i) for i in range(len(found)) for j in range(i + 1, len(found) + 1))
        start, end, n, similarity = license.aligned(target, found)
        assert similarity == pytest.approx(best) and n == agree(target, found[start:end])
        for least in (0.5, 0.8):
            assert license.aligned(target, found, least)[3] == pytest.approx(best if best >= least else 0)
    # the longest run of equal words is not on the best way
    assert license.aligned(list("abcxyabc"), list("abxcyzabc"))[2:] == (7, pytest.approx(14 / 17))
    assert license.differences(list("abcd"), list("axcde")) == "b => x;  => e"


def test_blocks_are_compressed_and_ranked_before_wording_is_compared(monkeypatch):
    scanner, tried, compare = license.Scanner(license.TEMPLATES), [], license.aligned
    monkeypatch.setattr(license, "aligned", lambda target, found, least=0.0: tried.append((target, found)) or compare(target, found, least))
    text = "we ship words under the " + license.TEMPLATES["MIT (text)"] + " more " + license.TEMPLATES["MPL-2.0"] + " and much more of the software"
    assert [license.spdx(n.name) for _, _, n in scanner.notices(text)] == ["MIT", "MPL-2.0"]
    name = {tuple(ws): name for name, ws in scanner.words.items()}
    savings = [scanner.saving(" ".join(block), name[tuple(target)]) for target, block in tried]
    assert len(savings) > 2 and savings == sorted(savings, reverse=True)


@pytest.mark.parametrize("n, width", [(500, 8), (30, 3), (1, 4)])
def test_top_k_matches_all_products(spark, n, width, monkeypatch):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, width)), 2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(20_000, None), (20_020, [1.0, None]), (20_040, [float("nan"), 1.0]), (None, [1.0]), (20_060, [float("inf")])], df.schema)
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BLOCK", 7)
    v = np.floor(x * 64).astype(int)
    want = set()
    for q in range(0, n, 20):
        scores = sorted(((-int(v[q] @ v[c]), c) for c in range(n) if c != q))[:20]
        want |= {(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores)}
    got = topk.top_inner_products(df.union(odd), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "row": F.lit(2), "vec": F.lit("x"), "asks": F.lit(3)})
    got = [tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") == 0, 3).collect()]
    assert sorted(got) == [(0, 1, 1, 32 * 64 + 576 * 64), (0, 2, 1, 32 * 64 + 576 * 64), (0, 3, 2, 32 * 192)]
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") == 0).count() == 0
