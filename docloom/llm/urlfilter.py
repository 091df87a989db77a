"""URL filters: rules by host and path, and for the rest the ratio of two character language models.

Variable-order Markov models of accepted and of rejected URLs, of up to three characters of context, are smoothed by
Witten-Bell interpolation: each order's estimate leans on the next lower one as far as its context has been followed by
different characters. A URL's score is the difference of its log-likelihoods, divided by its length; the threshold is
calibrated on rule-labelled URLs kept out of the models. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import saved

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER = 3
#: Most rows of a model table that are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
START = "\u0002"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict: tried from the longest, so the first that fits wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def positions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each character of ``letters``: the strings s1 to s4 that end there, START standing before the text."""
    at = F.explode(F.sequence(F.lit(1), F.length("letters")))
    out = rows.where(F.length("letters") > 0).withColumn("padded", F.concat(F.lit(START * ORDER), "letters")).withColumn("at", at)
    grams = [F.substring(F.col("padded"), F.col("at") + ORDER - k, F.lit(k + 1)).alias(f"s{k + 1}") for k in range(ORDER + 1)]
    return out.select(*keep, *grams)


def models(labelled: DataFrame) -> list[DataFrame]:
    """Tables by order k = 0..3, keyed by string: counts of the string of k + 1 characters in accepted and rejected URLs
    (na, nr); for a context also the total (ca, cr) and the kinds (ta, tr) of what follows it.

    Counted over all labelled rows: a row for each string and label, pre-aggregated before any shuffle.
    """
    grams = positions(labelled, ["label"])
    flat = grams.select("label", F.explode(F.array(*[F.col(f"s{k}") for k in range(1, ORDER + 2)])).alias("s"))
    n = flat.groupBy("s").agg(F.count_if(F.col("label") == "allow").alias("na"), F.count_if(F.col("label") == "block").alias("nr"))
    n = saved(n, "grams")
    context = n.groupBy(F.expr("substring(s, 1, length(s) - 1)").alias("c")).agg(
        F.sum("na").alias("ca"), F.sum("nr").alias("cr"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nr") > 0).alias("tr")
    )
    return [n, saved(context, "contexts")]


def _joinable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scored(rows: DataFrame, model: list[DataFrame], keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of each row of ``rows`` (they must tell rows apart); empty texts have no score."""
    n, c = model
    x = positions(rows, keep)
    n_rows, c_rows = _joinable(n), _joinable(c)
    x = x.withColumn("c0", F.lit(""))
    for k in range(1, ORDER + 1):
        x = x.withColumn(f"c{k}", F.expr(f"substring(s{k + 1}, 1, {k})"))
    x = x.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
    for k in range(ORDER + 1):
        grams = n_rows.select(F.col("s").alias(f"s{k + 1}"), "na", "nr")
        contexts = c_rows.select(F.col("c").alias(f"c{k}"), "ca", "cr", "ta", "tr")
        x = x.join(contexts, f"c{k}", "left").join(grams, f"s{k + 1}", "left")
        new = {}
        for m in "ar":
            total, kinds = F.coalesce(F.col(f"c{m}"), F.lit(0)), F.coalesce(F.col(f"t{m}"), F.lit(0))
            mixed = (F.coalesce(F.col(f"n{m}"), F.lit(0)) + kinds * F.col(f"p{m}")) / (total + kinds)
            new[f"p{m}"] = F.when(total > 0, mixed).otherwise(F.col(f"p{m}"))
        x = x.withColumns(new).drop("na", "nr", "ca", "cr", "ta", "tr")
    return x.groupBy(*keep).agg(F.round(F.avg(F.log("pa") - F.log("pr")), 9).alias("score"))


def threshold(scores: DataFrame) -> float:
    """From (label, score): the score, to two decimals within -10 and 10, at or above which allowing makes the greatest
    sum of the shares of accepted URLs allowed and rejected ones blocked; 0 where either kind is missing."""
    at = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.round(F.col("score") * 100))).cast("int").alias("at")
    got = scores.groupBy(at).agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r"))
    rows = sorted(got.collect())
    a, r = sum(x.a for x in rows), sum(x.r for x in rows)
    if not a or not r:
        return 0.0
    best, right, below = (-1.0, 0.0), 0.0, None
    up, down = a, 0
    for row in rows:
        share = up / a + down / r
        if share > best[0] + 1e-12:
            best, right = (share, row.at), (row.at if below is None else (row.at + below) / 2) / 100
        up, down, below = up - row.a, down + row.r, row.at
    return right


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict, score).

    Where no rule fits, the verdict is the models', which see the whole URL in ASCII lower case: allow if the score reaches the
    calibrated threshold. A null url or one without ``://`` has an empty host and path and fits no rule; a null or empty one
    scores 0 and is blocked unless the threshold lets 0 pass. Very long URLs are scored whole. Without URLs of both labels the models say nothing: scores are 0, verdicts allow.
    Repeated rows come out once each, null page_ids are kept, other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER).alias("letters"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("label"))
    # Counted and scored once for each different text; rows that repeat one are summed before they are shuffled.
    labelled = rows.where("label is not null").select("label", "letters")
    kept_out = F.conv(F.substring(F.md5("letters"), 1, 8), 16, 10).cast("long") % 5 == 0
    model = models(labelled.where(~kept_out))
    limit = threshold(scored(labelled.where(kept_out).distinct(), model, ["label", "letters"]))
    rest = rows.where("label is null").select("letters").distinct()
    scores = scored(rest, model, ["letters"])
    out = rows.join(scores, "letters", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    said = F.coalesce(F.col("label"), F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "score")


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """``judge`` as SQL of another engine, over a table ``pages``."""
    whens = [(f"(host = '{d}' or ends_with(host, '.{d}')) and starts_with(path, '{p}')", d + p, v) for v, d, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)]
    rule, verdict = ("case " + " ".join(f"when {w} then '{x[k]}'" for w, *x in whens) + " end" for k in (0, 1))
    start = f"repeat(chr({ord(START)}), {ORDER})"
    grams = ", ".join(f"substr(padded, pos + {ORDER - k}, {k + 1}) as s{k + 1}" for k in range(ORDER + 1))
    joins = " ".join(f"left join c as c{k} on c{k}.c = substr(s{k + 1}, 1, {k}) left join n as n{k} on n{k}.s = s{k + 1}" for k in range(ORDER + 1))
    p = {}
    for m in "ar":
        p[m] = "(1 / 256::double)"
        for k in range(ORDER + 1):
            p[m] = f"(case when coalesce(c{k}.c{m}, 0) > 0 then (coalesce(n{k}.n{m}, 0) + c{k}.t{m} * {p[m]}) / (c{k}.c{m} + c{k}.t{m})::double else {p[m]} end)"
    return f"""with raw as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as letters from pages),
ruled as (select *, {rule} as rule, {verdict} as label, ('0x' || substr(md5(letters), 1, 8))::bigint % 5 = 0 as out from raw),
places as (select label, out, letters, {start} || letters as padded, unnest(range(1, length(letters) + 1)) as pos from ruled),
grams as (select label, out, letters, pos, {grams} from places),
n as (select s, count(*) filter (label = 'allow') as na, count(*) filter (label = 'block') as nr from (
  select label, unnest([{", ".join(f"s{k + 1}" for k in range(ORDER + 1))}]) as s from grams where label is not null and not out) group by s),
c as (select substr(s, 1, length(s) - 1) as c, sum(na) as ca, sum(nr) as cr, count(*) filter (na > 0) as ta, count(*) filter (nr > 0) as tr from n group by 1),
scores as (select label, letters, round(avg(ln({p["a"]}) - ln({p["r"]})), 9) as score from (select distinct * from grams where label is null or out) {joins} group by label, letters),
marks as (select greatest(-1000, least(1000, round(score * 100)))::int as mark, count(*) filter (label = 'allow') as a, count(*) filter (label = 'block') as r from scores where label is not null group by 1),
shares as (select mark, lag(mark) over (order by mark) as below, (sum(a) over (order by mark desc)) / sum(a) over () + coalesce(sum(r) over (order by mark rows between unbounded preceding and 1 preceding), 0) / sum(r) over () as share from marks),
cut as (select case when below is null then mark / 100 else (mark + below) / 200 end as t from shares where (select sum(a) > 0 and sum(r) > 0 from marks) order by round(share, 10) desc, mark limit 1)
select page_id, host, path, rule, coalesce(u.label, case when coalesce(score, 0) >= coalesce((select t from cut), 0) then 'allow' else 'block' end) as verdict, coalesce(score, 0)::double as score
from ruled u left join scores s on u.letters = s.letters and s.label is null"""
