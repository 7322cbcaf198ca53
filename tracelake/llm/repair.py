"""Conversation structure repair by iterative-deepening A*.

A conversation's rows shall become a list whose role initials read ``(s?(ua)+)?``: nothing, or
turns of user and assistant in alternation after at most one system turn. Edits, in ASCII order:

* ``D`` deletes the next row, 4; blank and duplicate rows must go this way.
* ``I`` inserts an empty-text user or assistant turn, 3.
* ``K`` keeps the next row.
* ``R`` gives the next row the role user or assistant, 3.

A truncated row that stays costs 3 more. Which role an insertion or a new role takes follows from
the place reached, so the edits' initials name a repair. The search walks edits depth first in that
order under a cost bound; a table holds, for each (row, place) that failed, the least cost now
known from there, which prunes later visits and gives the next bound. The first path accepted is
the cheapest repair, and of equally cheap ones the ASCII-least. Bounds are learned from the end of
the conversation backwards in steps of ``STRIDE`` rows, so the work grows with the number of rows.

On Spark, a first pass sees a few bytes per row, in order of turn, and finds the edits; the second
streams the texts beside them and hashes the repaired conversation. Neither holds the texts of a
conversation: the search keeps two bytes and a 16-byte digest per row. A conversation is one task's
work, as its edits are one string of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, sql_crc32, table

STRIDE = 64
_INFINITE = 1 << 60
MOST = (1 << 63) - 1
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# places: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
_ROLE = {"u": "user", "a": "assistant"}
_DONE = (START, ASSISTANT)

_FACTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_NAMES = [c.split()[0] for c in _FACTS.split(", ")]


def _choices(row: tuple[str, str] | None, place: int) -> list[tuple[str, int, int, int]]:
    """Edits ``(initial, cost, rows taken, next place)`` from ``place``, in ASCII order."""
    wanted, after = _NEXT[place]
    insert = ("I", INSERT, 0, after)
    if row is None:
        return [insert]
    fault, initial = row
    out = [("D", DELETE, 1, place), insert]
    if fault in ("blank", "duplicate"):
        return out
    extra = TRUNCATED if fault == "truncated" else 0
    if initial == wanted:
        out.append(("K", extra, 1, after))
    elif place == START and initial == "s":
        out.append(("K", extra, 1, SYSTEM))
    out.append(("R", REROLE + extra, 1, after))
    return out


def cheapest_repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of ``(fault, role initial)`` rows, ties to the ASCII-least edits.

    ``fault`` is blank, duplicate, truncated or empty. No rows need no edits.
    """
    n = len(rows)
    least = {"blank": DELETE, "duplicate": DELETE, "truncated": min(DELETE, TRUNCATED)}
    bound = [[0] * 4 for _ in range(n + 1)]
    bound[n] = [0 if p in _DONE else INSERT for p in range(4)]  # a user turn is owed an answer
    bound[n][SYSTEM] = 2 * INSERT
    known: dict[tuple, list] = {}

    def edits(at: int, place: int) -> list:
        if at == n:
            return _choices(None, place)
        key = (rows[at], place)
        if key not in known:
            known[key] = _choices(rows[at], place)
        return known[key]

    def search(start: int, place: int, limit: int, end: int) -> str | None:
        """The first path of edits within ``limit`` to an accepting end, or to row ``end`` short of
        it, from where bounds are exact; None with ``bound`` raised."""
        # a frame: row, place, budget left, its edits, the next of them, least cost seen to fail
        stack = [[start, place, limit, edits(start, place), 0, _INFINITE]]
        path: list[str] = []
        if start == n and place in _DONE:
            return ""
        while stack:
            frame = stack[-1]
            at, place, left, choices, k, failed = frame
            if k == len(choices):
                bound[at][place] = max(bound[at][place], failed)
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    initial, cost, taken, after = above[3][above[4] - 1]
                    above[5] = min(above[5], cost + bound[at][place])
                continue
            frame[4] += 1
            initial, cost, taken, after = choices[k]
            to, rest = at + taken, left - cost
            if bound[to][after] > rest:
                frame[5] = min(failed, cost + bound[to][after])
                continue
            path.append(initial)
            if to == end and (end < n or after in _DONE):
                return "".join(path)
            stack.append([to, after, rest, edits(to, after), 0, _INFINITE])
        return None

    def deepened(start: int, place: int, end: int) -> str:
        while True:
            found = search(start, place, bound[start][place], end)
            if found is not None:
                return found

    below = n
    while below > 0:
        above = max(0, below - STRIDE)
        sure = min(bound[below])
        for at in range(below - 1, above - 1, -1):
            sure += least.get(rows[at][0], 0)
            bound[at] = [sure] * 4
        if above > 0:
            for place in range(4):
                deepened(above, place, below)
        below = above
    audit = deepened(0, START, n)
    return bound[0][START], audit


class _Conversation:
    """Facts of one conversation, gathered row by row."""

    def __init__(self, conv):
        self.conv, self.rows, self.seen = conv, [], set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.low, self.high, self.turns, self.last = 0, None, None, 0, None

    def add(self, turn, digest: bytes, initial: str, blank: bool, open_end: bool) -> None:
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if open_end else ""
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        if self.rows and self.rows[-1][1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((fault, initial))
        if turn is not None and turn != self.last:  # turns arrive in order
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.turns += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        cost, audit = cheapest_repair(self.rows)
        return (self.conv, gaps, *self.counts.values(), self.illegal, cost, audit)


def _number(text: str | None) -> int | None:
    """Whole numbers travel as text: with nulls beside them, pandas would round large ones."""
    return None if text is None else int(text)


def _as_text(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("string") for name in names}


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object).astype(dict.fromkeys(_NAMES[:-1], "Int64"))


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now = None
    for batch in batches:
        out = []
        for conv, turn, gone, digest, initial, blank, open_end in zip(
                batch["conv_id"], batch["turn"], batch["gone"], batch["digest"], batch["initial"], batch["blank"],
                batch["open_end"], strict=True):
            conv = _number(conv)
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            if not gone:
                now.add(_number(turn), bytes(digest), initial, blank, open_end)
        yield _framed(out, _NAMES)
    if now is not None:
        yield _framed([now.row()], _NAMES)


class _Repaired:
    """Streams the rows of one conversation past its edits into a hash."""

    def __init__(self, facts: tuple):
        self.facts, self.audit, self.at, self.place = facts, facts[-1], 0, START
        self.hash, self.first = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.first = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial, self.place = _NEXT[self.place]
            self._put(_ROLE[initial], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        initial, after = _NEXT[self.place]
        if edit == "R":
            role = _ROLE[initial]
        elif self.place == START and role[:1] == "s":
            after = SYSTEM
        self.place = after
        self._put(role, text)

    def row(self) -> tuple:
        self._inserted()
        return *self.facts, self.hash.hexdigest()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one conversation come together, the one with its facts first."""
    now = None
    for batch in batches:
        out = []
        facts = batch[_NAMES].itertuples(index=False, name=None)
        for fact, role, text in zip(facts, batch["role"], batch["text"], strict=True):
            if fact[-1] is None:
                now.add(role, text)
                continue
            if now is not None:
                out.append(now.row())
            now = _Repaired(tuple(map(_number, fact[:-1])) + (fact[-1],))
        yield _framed(out, [*_NAMES, "repaired_sha256"])
    if now is not None:
        yield _framed([now.row()], [*_NAMES, "repaired_sha256"])


def _digest(*parts: Column) -> Column:
    """First 16 bytes of SHA-256 of the parts, each but the last with its length in front."""
    fed = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts[:-1]]
    return F.unhex(F.substring(F.sha2(F.concat(*fed, parts[-1]).cast("binary"), 256), 1, 32))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Per conv_id: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has conv_id, turn, role and text, and may have a boolean ``gone``: such rows are not
    there, but their conversation is still reported, with zeros, no edits and the hash of nothing if
    no row is left. Null role or text is one space. Rows stand in order of turn, nulls first; rows of
    one turn in order of a digest of role and text, so equal rows are neighbours. Rows with a null
    conv_id are one conversation. Gaps beyond a long are its largest value. Further columns are not read.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    ready = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), gone.alias("gone"),
        role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))
    trimmed = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    blank = F.length(trimmed) == 0
    small = ready.select(
        "conv_id", "turn", "gone", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open_end"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    in_order = small.repartition("conv_id").sortWithinPartitions(*order).withColumns(_as_text("conv_id", "turn"))
    judged = in_order.mapInPandas(_judged, _FACTS)

    types = dict(c.split() for c in _FACTS.split(", ")) | {"turn": "long", "digest": "binary", "role": "string", "text": "string"}
    empty = lambda *names: [F.lit(None).cast(types[c]).alias(c) for c in names]
    head = judged.select(*_NAMES, F.lit(0).alias("kind"), *empty("turn", "digest", "role", "text"))
    body = ready.where(~F.col("gone")).select("conv_id", *empty(*_NAMES[1:]), F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    return (
        head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest")
        .select(*_as_text(*_NAMES[:-1]).values(), "audit", "role", "text").toDF(*_NAMES, "role", "text")
        .mapInPandas(_hashed, f"{_FACTS}, repaired_sha256 string")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` with damage by ``crc32(conv_id:turn) % 20``, nulls taken as one space.

    0 marks the row as gone, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row and 4
    makes its role user.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text, role = as_text("text"), as_text("role")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            (F.col("kind") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


def _check() -> str:
    """Cheapest repairs from the last row backwards, per place, as twelve digits of cost before the edits."""

    def before(edit: str, cost: str, rest: str) -> str:
        return f"lpad((substr({rest}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{edit}' || substr({rest}, 13)"

    def taken(place: int) -> str:
        initial, after = _NEXT[place]
        stays = f"CASE WHEN fault IN ('', 'truncated') THEN {before('R', f'{REROLE} + extra', f'v{after}')} END"
        kept = f"CASE WHEN fault IN ('', 'truncated') AND initial = '{initial}' THEN {before('K', 'extra', f'v{after}')} END"
        system = f"CASE WHEN fault IN ('', 'truncated') AND initial = 's' THEN {before('K', 'extra', 'v1')} END"
        options = [before("D", str(DELETE), f"v{place}"), kept, stays] + [system] * (place == START)
        return f"least({', '.join(options)}) AS b{place}"

    return f"""
WITH RECURSIVE original AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM original),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged),
judged AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id),
best AS (
    SELECT conv_id, n + 1 AS i, '000000000000' AS v0, '000000000006II' AS v1, '000000000003I' AS v2, '000000000000' AS v3 FROM counted
    UNION ALL
    SELECT conv_id, i, least(b0, {before("I", str(INSERT), f"least(b2, {before('I', str(INSERT), 'b3')})")}),
        least(b1, {before("I", str(INSERT), f"least(b2, {before('I', str(INSERT), 'b3')})")}),
        least(b2, {before("I", str(INSERT), "b3")}), least(b3, {before("I", str(INSERT), "b2")})
    FROM (SELECT conv_id, i, {", ".join(taken(p) for p in range(4))}
        FROM (SELECT b.*EXCLUDE (i), j.i, j.fault, j.initial, CASE j.fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra
            FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1))),
found AS (SELECT conv_id, substr(v0, 1, 12)::BIGINT AS cost, substr(v0, 13) AS audit FROM best WHERE i = 1),
edits AS (
    SELECT conv_id, k, substr(audit, k, 1) AS edit, length(replace(substr(audit, 1, k), 'I', '')) AS i
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM found)),
put AS (
    SELECT e.conv_id, e.k, e.edit, j.role, CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text,
        row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS nth, e.edit = 'K' AND j.initial = 's' AS is_system
    FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i WHERE e.edit <> 'D'),
spoken AS (
    SELECT conv_id, k, text, CASE WHEN edit = 'K' THEN role WHEN (nth - max(is_system::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user'
        ELSE 'assistant' END AS role FROM put),
whole AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY k) AS body FROM spoken GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op13_conversation_repair", _check())
def op13(spark, folder):
    return repaired_conversations(damaged(table(spark, folder, "conversations")))
