"""Conversation trie and repair, and the URL filter: plain loops, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracelake.llm import repair, trie, urls

TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi there"), (2, 0, "user", "hello"), (2, 1, "assistant", "hi there"), (2, 2, "user", "bye"),
    (3, 0, "user", "hello"), (4, None, None, None), (4, 5, "user", "late"), (5, 0, "user", "hello"), (5, 0, "user", "hello"),
    (7, 1, "", "x" * 70_000), (None, 0, "user", "hello"), (None, None, None, None), (-150, 0, "user", "hello"), (-100, 3, "user", "été ✓"),
    (102, 0, "user", "hello"), (100, 0, "system", ""), (100, 1, "user", "hello."), (100, 1, "user", "other."),
]


@pytest.fixture(scope="module")
def turns(spark):
    extra = "label string, n int, head string, path string, key string, kind string, audit string, block long"
    rows = [(*t, "x", 1, "h", "p", "k", "d", "a", 0) for t in TURNS]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, {extra}")


# trie


def plain_lists(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            fed = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:trie.HEX]
            out[conv].append((turn is not None, turn or 0, fed, role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def plain_rebuilt(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = lists.get(c - int(math.fmod(c, 100)), [])
        out[c] = base[:h] + own[h:]
    return out


def plain_trie(lists):
    members, rows = defaultdict(list), set()
    for c, path in lists.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in convs if len(lists[c]) == len(p))))
        rows.add((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(kids[q] == 0 for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_trie_of_odd_rows(turns, cells):
    lists = trie.turn_lists(turns)
    plain = plain_lists(TURNS)
    for found, wanted in ((lists, plain), (trie.with_shared_heads(lists), plain_rebuilt(plain))):
        out = trie.prefix_trie(found, cells).collect()
        assert len(out) == len(set(out)) and set(map(tuple, out)) == plain_trie(wanted)


@pytest.mark.parametrize("cells", [3, 50])
def test_trie_across_blocks(spark, cells):
    random.seed(3)
    rows = []
    for c in range(120):  # a third are copies of one, the others share first turns; one is long
        path = [("user", "copy"), ("assistant", "same")] if c % 3 == 0 else [("user", random.choice("ab"))] * random.randrange(4)
        path = path + [("user", random.choice("xy")) for _ in range(random.randrange(3) if c % 3 else 0)]
        path = [("user", str(i)) for i in range(70)] if c == 50 else path
        rows += [(c, i, r, t) for i, (r, t) in enumerate(path)]
    out = trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), cells)
    assert set(map(tuple, out.collect())) == plain_trie(plain_lists(rows))


def test_trie_of_no_conversations(turns):
    assert trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(turns.limit(0)))).count() == 0


# repair


def cheapest(rows):
    """Cost and edits from the last row backwards."""
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    best[-1] = [(0, "") if p in (repair.START, repair.ASSISTANT) else None for p in range(4)]
    for at in range(len(rows), -1, -1):
        for turn in range(4):  # one pass takes rows, the others insert
            for place in range(4):
                for initial, cost, taken, after in repair._choices(rows[at] if at < len(rows) else None, place):
                    if taken == (turn == 0) and best[at + taken][after]:
                        rest = best[at + taken][after]
                        best[at][place] = min(x for x in (best[at][place], (cost + rest[0], initial + rest[1])) if x)
    return best[0][repair.START]


@pytest.mark.parametrize("seed, n", [(1, 5), (2, 9), (3, 40), (4, 200), (5, 700)])
def test_repair_is_cheapest_and_least(seed, n):
    draw = random.Random(seed)
    for _ in range(3 if n > 100 else 200):
        rows = [(draw.choice(["", "", "", "blank", "duplicate", "truncated"]), draw.choice("uaaust")) for _ in range(draw.randrange(n + 1))]
        assert repair.cheapest_repair(rows) == cheapest(rows)


def test_repair_of_odd_rows(turns):
    out = {r["conv_id"]: r for r in repair.repaired_conversations(turns).collect()}
    assert len(out) == len({t[0] for t in TURNS})
    sha = lambda *turns: hashlib.sha256("\n".join(turns).encode()).hexdigest()
    assert out[1][1:] == (0, 0, 0, 2, 0, 6, "KK", sha("user:hello", "assistant:hi there"))
    assert out[3][1:] == (0, 0, 0, 1, 0, 4, "D", sha())
    assert out[5][1:5] == (0, 0, 1, 1) and out[5]["audit"] == "DD" and out[5]["cost"] == 8
    assert out[4]["blank"] == 1 and out[4]["gaps"] == 0
    assert out[7]["truncated"] == 1 and out[7]["audit"] == "D"
    assert out[100]["gaps"] == 1 - 0 + 1 - 2 and out[100]["blank"] == 1 and out[100]["audit"].startswith("D")
    assert out[None]["duplicate"] == 0 and out[None]["blank"] == 1
    assert repair.repaired_conversations(turns.limit(0)).count() == 0


def test_repair_keeps_large_numbers(spark):
    big = (1 << 62) + 1
    rows = [(big, big, "user", "a."), (big, -big, "assistant", "b."), (big, None, "user", "c."), (None, 1, "user", "d."), (big + 1, 5, "user", "e.")]
    out = {r["conv_id"]: r for r in repair.repaired_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {big, big + 1, None}
    small = [(big, 1 << 60, "user", "a."), (big, 3, "assistant", "b."), (None, 1, "user", "d.")]
    got = {r["conv_id"]: r["gaps"] for r in repair.repaired_conversations(spark.createDataFrame(small, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {big: (1 << 60) - 3 + 1 - 2, None: 0}


def test_repair_without_rows_left(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    row = repair.repaired_conversations(repair.damaged(df)).first()
    assert row[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_text(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([
        ("system", "Rules."), ("assistant", "First."), ("assistant", "Second."), ("user", " "), ("user", "Ask?"), ("user", "Ask?"), ("tool", "Out!")])]
    row = repair.repaired_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (row["blank"], row["duplicate"], row["truncated"]) == (1, 1, 0)
    parts, place, at = [], "u", 0
    for edit in row["audit"]:
        if edit != "I":
            _, _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K" and role == "system":
            parts.append(f"{role}:{text}")
            continue
        parts.append(f"{({'u': 'user', 'a': 'assistant'}[place])}:{'' if edit == 'I' else text}")
        place = "a" if place == "u" else "u"
    assert place == "u" and at == len(rows)
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(parts).encode()).hexdigest()


# urls


def plain_verdicts(given, rules):
    """Host, path, rule, verdict and score of each url by loops."""
    def parsed(url):
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        return rest[:cut].translate(str.maketrans(dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True)))), tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]

    def ruled(host, path):
        fits = [(len(r), v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.find("/"):])]
        return max(fits) if fits else None

    def folded(url):
        low = "".join(c.lower() if c.isascii() else c for c in url or "")
        return "^^^" + "".join("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz" + urls._MARKS else "*" for c in low) + "$"

    rows = [(url, *parsed(url)) for url in given]
    fits = [ruled(h, p) for _, h, p in rows]
    spare = [hashlib.md5((u or "").encode()).hexdigest()[0] in "012" for u in given]
    models = {v: (Counter(), defaultdict(Counter)) for v in ("allow", "block")}
    for url, fit, out in zip(given, fits, spare, strict=True):
        if fit and not out:
            s = folded(url)
            for i in range(3, len(s)):
                for n in range(4):
                    models[fit[1]][1][s[i - n:i]][s[i]] += 1

    def chance(model, context, c):
        p = 1 / 39
        for n in range(4):
            after = model[1].get(context[3 - n:])
            if after:
                p = (after[c] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    def score(url):
        s = folded(url)
        return sum(math.log(chance(models["allow"], s[i - 3:i], s[i]) / chance(models["block"], s[i - 3:i], s[i])) for i in range(3, len(s))) / (len(s) - 3)

    bins = Counter((math.floor(score(u) / 0.01), f[1]) for u, f, out in zip(given, fits, spare, strict=True) if f and out)
    total = {v: sum(n for (_, w), n in bins.items() if w == v) for v in models}
    cut = 0
    if all(total.values()):
        gain = lambda b: sum(n for (x, v), n in bins.items() if x >= b and v == "allow") / total["allow"] - sum(n for (x, v), n in bins.items() if x >= b and v == "block") / total["block"]
        cut = min({b for b, _ in bins}, key=lambda b: (-round(gain(b), 12), abs(b), -b))
    return [(h, p, f[2] if f else None, f[1] if f else ("allow" if score(u) >= cut * 0.01 else "block")) for (u, h, p), f in zip(rows, fits, strict=True)]


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/De/x", "https://example.com/de/", "ftp://a.b.example.net/en/?q=1#x", "http://x.net",
       "http://x.net/?a://b.org/fr/", "http://é.org/fr/ü", "://org/fr/", "http://" + "long" * 20_000 + ".org/es/", "http://example.net/en/" * 3]


def test_urls_match_plain_models(spark, sample):
    given = [r["url"] for r in sample("pages").select("url").collect()] + ODD + ODD[:5]
    df = spark.createDataFrame([(i, u, "h", 1, "g") for i, u in enumerate(given)], "page_id long, url string, host string, row int, gram string")
    out = urls.judge_urls(df).orderBy("page_id").collect()
    wanted = plain_verdicts(given, urls.RULES)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == wanted
    assert all((r["score"] is None) == (r["rule"] is not None) for r in out)
    assert {"row", "gram", "score"} <= set(urls.judge_urls(df).columns)


def test_urls_without_rows_or_rules(spark, sample):
    pages = sample("pages").select("page_id", "url")
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judge_urls(pages, rules=[("drop", "net/")])


def test_longer_rules_win(spark):
    df = spark.createDataFrame([(0, "http://a.example.net/en/x"), (1, "http://example.netx/en/"), (2, "http://net/")], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert out[0] == ("example.net/en/", "allow") and out[1][0] is None and out[2] == ("net/", "block")
