"""URL filter: rules on host and path, and a character language-model ratio for what no rule covers.

Rules label the urls that they cover as accepted or rejected. Over each class a Markov model of
variable order predicts the next character from up to ``ORDER - 1`` before it: Witten-Bell smoothing
weighs what was counted after a context against the prediction of the next shorter one, down to
equal chances, and a context that the class never had passes on to the shorter one. A url's score is
the mean over its characters of the difference of log-likelihoods, so long urls are not favoured. The
cut is calibrated on labelled urls that the models did not learn from: it has the greatest share of
accepted urls let through less that of rejected ones.

Characters fold into ``SYMBOLS`` classes (A-Z as a-z, all digits one, rare ones one), so the models
have at most ``SYMBOLS ** ORDER`` entries, 2.3 million, however many urls there are. That is the proven
bound of the table which is broadcast to score. Counting combines before the shuffle and scoring sums
where a url is read, so a host with a third of all rows is no heavier than others. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep, lower_ascii, query, table

ORDER = 4
SYMBOLS = 39  # 26 letters, digits, ten marks, any other, and the end
STEP = 0.01  # width of the bins among which the cut is chosen
_MARKS = "/.:?=&#%_-"
_START, _END = "^" * (ORDER - 1), "$"

# fixed values of the dealt query
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(size, verdict, rule)`` of the longest rule that fits, or null.

    A rule is a host and a path. It fits the host and its subdomains where the path starts with the
    rule's. Block wins over allow for one and the same rule. The rules stand in the plan, so they
    are a list of hundreds at most, not a table.
    """
    if len(rules) > 1000:
        raise ValueError("rules are part of the plan: give at most a thousand")
    fits = []
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict!r}")
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def _grams(url: Column) -> Column:
    """The folded url's runs of ``ORDER`` symbols, one per character and one for the end."""
    digits = F.translate(lower_ascii(url), "123456789", "000000000")
    folded = F.regexp_replace(digits, f"[^a-z0{_MARKS}]", "*")
    padded = F.concat(F.lit(_START), folded, F.lit(_END))
    return F.regexp_extract_all(padded, F.lit(f"(?=(.{{{ORDER}}}))"), F.lit(1))


def _model(counts: DataFrame) -> DataFrame:
    """``gram, weight`` from ``gram, a, r``: log of the gram's last symbol's chance if accepted less that if rejected."""
    below = None
    for n in range(1, ORDER + 1):
        here = counts.groupBy(F.substring("gram", ORDER + 1 - n, n).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        here = here.withColumn("context", F.substring("g", 1, n - 1)).withColumn("shorter", F.substring("g", 2, n - 1))
        contexts = here.groupBy("context").agg(
            *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.count_if(F.col(c) > 0).alias(f"t{c}") for c in "ar"])
        joined = here.join(contexts, "context")
        if below is None:
            joined = joined.withColumns({"pa": F.lit(1 / SYMBOLS), "pr": F.lit(1 / SYMBOLS)})
        else:
            joined = joined.join(below.withColumnRenamed("g", "shorter"), "shorter")
        smooth = lambda c: F.when(
            F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}"))
        below = joined.select("g", smooth("a").alias("pa"), smooth("r").alias("pr"))
    return below.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("weight"))


def _cut(held: DataFrame) -> float:
    """The calibrated cut from ``score, verdict`` of labelled urls; 0 if they are of one kind only."""
    at = held.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    above = Window.orderBy(F.desc("bin"))  # one row per bin; scores lie within a few hundred, whatever the input
    every = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    through = lambda c: F.try_divide(F.sum(c).over(above), F.sum(c).over(every))
    with_both = at.withColumn("gain", through("a") - through("r")).where("gain is not null")
    best = with_both.orderBy(F.desc("gain"), F.abs("bin"), F.desc("bin")).select("bin").first()
    return best["bin"] * STEP if best else 0.0


def judge_urls(rows: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """``rows`` with ``host, path, rule, verdict, score``: the rule's verdict, or the models' where no rule fits.

    ``score`` is null where a rule decides; else ``verdict`` is allow at the calibrated cut or above. A
    null url is scored as an empty one. Without any labelled url all score 0 and pass. Repeated rows
    each get their verdict. Columns of ``rows`` named like a result give way to it; maps are not
    allowed, as rows are grouped.
    """
    found = ("host", "path", "rule", "verdict", "score")
    given = rows.drop(*[c for c in rows.columns if c.lower() in found])
    row, gram, weight, fit, held, marked = fresh(given, "row", "gram", "weight", "fit", "held", "marked")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    # one url in five or so of those that rules cover is kept from the models, with all its copies
    spare = F.substring(F.md5(F.coalesce(F.col(url), F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2")
    ready = given.withColumns({"host": host, "path": path}).withColumn(fit, longest_rule(F.col("host"), F.col("path"), rules))
    ready = ready.withColumn(held, F.col(fit).isNotNull() & spare).withColumn(marked, F.col(f"{fit}.verdict"))

    learns = F.col(fit).isNotNull() & ~F.col(held)
    counts = keep(
        ready.select(F.when(learns, F.col(marked)).alias("kind"), F.explode(_grams(F.col(url))).alias("gram"))
        .groupBy("gram").agg(F.count_if(F.col("kind") == "allow").alias("a"), F.count_if(F.col("kind") == "block").alias("r")))
    model = _model(counts).toDF(gram, weight)

    asked = F.when(F.col(fit).isNull() | F.col(held), _grams(F.col(url)))
    names = [*given.columns, "host", "path", fit, held]
    scored = keep(
        ready.withColumn(row, F.monotonically_increasing_id())
        .select(row, *names, F.explode_outer(asked).alias(gram))
        .join(F.broadcast(model), gram, "left")
        .groupBy(row, *names).agg(F.avg(weight).alias("score")).drop(row))
    cut = _cut(scored.where(held).select("score", F.col(f"{fit}.verdict").alias("verdict")))
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(
        *given.columns, "host", "path", F.col(f"{fit}.rule").alias("rule"), F.coalesce(f"{fit}.verdict", by_score).alias("verdict"),
        F.when(F.col(fit).isNull(), F.col("score")).alias("score"))


def _check() -> str:
    levels = []
    for n in range(1, ORDER + 1):
        shorter = f"JOIN p{n - 1} b ON b.g = substr(h.g, 2, {n - 1})" if n > 1 else f"CROSS JOIN (SELECT 1.0::DOUBLE / {SYMBOLS} AS pa, 1.0::DOUBLE / {SYMBOLS} AS pr) b"
        smooth = lambda c: f"CASE WHEN n{c} > 0 THEN ({c} + t{c} * p{c}) / (n{c} + t{c})::DOUBLE ELSE p{c} END AS p{c}"
        levels.append(f"""c{n} AS (SELECT substr(gram, {ORDER + 1 - n}, {n}) AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
x{n} AS (SELECT substr(g, 1, {n - 1}) AS context, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM c{n} GROUP BY 1),
p{n} AS (SELECT h.g, {smooth("a")}, {smooth("r")} FROM c{n} h JOIN x{n} x ON x.context = substr(h.g, 1, {n - 1}) {shorter})""")
    rules = [f"({len(rule)}, '{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in RULES]
    return f"""
WITH rules(size, verdict, rule, name, start) AS (VALUES {", ".join(rules)}),
parsed AS (
    SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS id FROM pages),
fitted AS (
    SELECT id, arg_max(r.rule, size) AS rule, arg_max(r.verdict, size) AS verdict FROM parsed
    JOIN rules r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY id),
ready AS (
    SELECT p.*, rule, verdict, rule IS NOT NULL AND substr(md5(url), 1, 1) IN ('0', '1', '2') AS held,
        '{_START}' || regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0{_MARKS}]', '*', 'g') || '{_END}' AS padded
    FROM parsed p LEFT JOIN fitted f USING (id)),
grams AS (SELECT id, held, rule, verdict, unnest(list_transform(range(1, length(padded) - {ORDER - 2}), lambda i: substr(padded, i, {ORDER}))) AS gram FROM ready),
counts AS (
    SELECT gram, count(*) FILTER (verdict = 'allow' AND NOT held) AS a, count(*) FILTER (verdict = 'block' AND NOT held) AS r FROM grams GROUP BY gram),
{", ".join(levels)},
scored AS (SELECT id, avg(ln(pa) - ln(pr)) AS score FROM grams JOIN p{ORDER} ON g = gram WHERE rule IS NULL OR held GROUP BY id),
bins AS (
    SELECT floor(score / {STEP})::BIGINT AS bin, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r
    FROM scored JOIN ready USING (id) WHERE held GROUP BY 1),
gains AS (
    SELECT bin, sum(a) OVER above / (SELECT nullif(sum(a), 0) FROM bins)::DOUBLE - sum(r) OVER above / (SELECT nullif(sum(r), 0) FROM bins)::DOUBLE AS gain
    FROM bins WINDOW above AS (ORDER BY bin DESC)),
cut AS (SELECT coalesce((SELECT bin FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, abs(bin), bin DESC LIMIT 1), 0) * {STEP} AS at_least)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= at_least THEN 'allow' ELSE 'block' END) AS verdict
FROM ready LEFT JOIN scored USING (id) CROSS JOIN cut
"""


@query("op12_url_filter", _check())
def op12(spark, folder):
    return judge_urls(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
