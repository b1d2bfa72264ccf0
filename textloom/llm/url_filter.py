"""URL filters by a path-template tree, by DataFrame functions only.

Rules come first: the longest rule that fits a url's host (or a parent domain of it) and
the start of its path decides.  Urls without a rule are judged by their template.

1. Digit runs of segments become ``#``.  Equal shapes of one host are counted together (a
   partial aggregate), and all that follows works on these counts, not on pages.
2. Level by level, the children of a node become one wildcard ``*`` where there are more
   than ``fan`` of them and none few of them stand out: their effective number, (sum of
   n)^2 / (sum of n^2), is more than ``fan`` too, however many pages each has.
3. Other children of a node are merged where they are statistically similar.  What lies
   below a child is a distribution over forms (letters as ``a``).  Children whose most
   frequent form is the same make a pool; a child stays in it unless a chi-square test
   tells its distribution, or its share of blocked pages among those that a rule judged,
   from the pool's at the level ``doubt``.  The merged children are called by the smallest
   of them and ``~``.  A child that no rule knows is merged by what lies below it alone, and
   so shares the evidence of its kind.
4. A template (the path's names) is rejected when its smoothed labelled purity, (blocked +
   smooth * prior) / (labelled + smooth), is at least ``reject``.  The labels are the rules'
   own verdicts.

There is one small job for each level at which some host has two different segments,
however deep paths are; other levels cannot merge anything.  The verdicts go back to the
pages by one shuffled join on (host, shape), which adaptive execution splits where one shape
is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    prefix: str  # of the path, with its slash

    @property
    def text(self) -> str:
        return self.host + self.prefix


@dataclass(frozen=True)
class Limits:
    """``doubt``: the standard normal quantile of the tests' level, 2.326 for one in a hundred."""

    fan: int = 10
    doubt: float = 2.326
    smooth: float = 5.0
    prior: float = 0.1
    reject: float = 0.8


# The production rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.prefix)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def form(segments: Column) -> Column:
    """What segments look like: letters are ``a``, words in a row one ``a-a``."""
    letters = F.regexp_replace(F.array_join(segments, "/"), r"\p{L}+", "a")
    return F.regexp_replace(letters, "(?:a[-_])+a", "a-a")


def _allowed(df: Column, doubt: float) -> Column:
    """The chi-square value that is exceeded by chance at the level only (Wilson and Hilferty, 1931)."""
    part = 2 / (9 * df)
    return df * F.pow(1 - part + doubt * F.sqrt(part), F.lit(3.0))


def names(cells: DataFrame, limits: Limits) -> DataFrame:
    """(host, prefix, seg, name) for the children ``seg`` of nodes, given as cells (host, prefix, seg, form, n, labelled, blocked)."""
    node, child, pool = ["host", "prefix"], ["host", "prefix", "seg"], ["host", "prefix", "mode"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = cells.groupBy(*child).agg(*sums, F.max(F.struct("n", "form"))["form"].alias("mode"))
    number = F.col("n").cast("double")
    wide = children.groupBy(*node).agg(F.count("*").alias("fan"), (F.pow(F.sum(number), F.lit(2.0)) / F.sum(number * number)).alias("even"))
    wide = wide.filter((F.col("fan") > limits.fan) & (F.col("even") > limits.fan)).select(*node, F.lit(True).alias("wide"))
    pooled = children.groupBy(*pool).agg(F.sum("n").alias("of_pool"), F.sum("labelled").alias("known_of_pool"), F.sum("blocked").alias("blocked_of_pool"))
    mine = cells.join(children.select(*child, "mode"), child)
    forms = mine.groupBy(*pool, "form").agg(F.sum("n").alias("f"))
    kinds = forms.groupBy(*pool).agg((F.count("*") - 1).cast("double").alias("df"))
    # The sum of (seen - expected)^2 / expected is that of seen^2 / expected, less all seen.
    seen = mine.join(forms, [*pool, "form"]).groupBy(*child).agg(F.sum(number * number / F.col("f")).alias("squares"))
    out = children.join(pooled, pool).join(kinds, pool).join(seen, child).join(wide, node, "left")
    apart = F.col("squares") * F.col("of_pool") / number - number
    same = F.when(F.col("df") < 1, True).otherwise(apart <= _allowed(F.col("df"), limits.doubt))
    share, known = F.col("blocked_of_pool") / F.greatest(F.col("known_of_pool"), F.lit(1)), F.col("labelled").cast("double")
    differ = F.pow(F.col("blocked") - known * share, F.lit(2.0))
    fair = (F.col("labelled") == 0) | (differ <= limits.doubt**2 * known * share * (1 - share) + 1e-9)
    out = out.select(*child, "mode", "wide", (same & fair & F.col("wide").isNull()).alias("joins"))
    group = out.filter("joins").groupBy(*pool).agg(F.min("seg").alias("least"), F.count("*").alias("members")).filter("members > 1")
    out = out.join(group, pool, "left")
    merged = F.when(F.col("joins") & F.col("least").isNotNull(), F.concat("least", F.lit("~")))
    return out.select(*child, F.when(F.col("wide"), "*").otherwise(F.coalesce(merged, "seg")).alias("name"))


def templates(shapes: DataFrame, limits: Limits) -> DataFrame:
    """(host, shape, template, purity) for rows (host, shape, n, labelled, blocked), one for each shape."""
    parts = F.array_remove(F.split("shape", "/"), "")
    rows = cut(shapes.select("host", "shape", "n", "labelled", "blocked", parts.alias("parts"), F.array().cast("array<string>").alias("named")))
    levels = rows.select("host", F.posexplode("parts").alias("k", "seg")).groupBy("host", "k").agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    for k in sorted(r.k for r in levels.filter("a <> b").select("k").distinct().collect()):
        upto = F.concat("named", F.slice("parts", F.size("named") + 1, F.greatest(k - F.size("named"), F.lit(0))))
        deep = rows.filter(F.size("parts") > k).select("host", "shape", F.array_join(upto, "/").alias("prefix"), F.get("parts", F.lit(k)).alias("seg"), form(F.slice("parts", k + 2, F.size("parts"))).alias("form"), "n", "labelled", "blocked")
        cells = cut(deep.groupBy("host", "prefix", "seg", "form").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))))
        found = deep.select("host", "shape", "prefix", "seg").join(names(cells, limits), ["host", "prefix", "seg"]).select("host", "shape", "name")
        step = F.when(F.col("name").isNotNull(), F.concat(upto, F.array("name"))).otherwise(F.col("named"))
        rows = cut(rows.join(found, ["host", "shape"], "left").withColumn("named", step).drop("name"))
    template = F.array_join(F.concat("named", F.slice("parts", F.size("named") + 1, F.size("parts"))), "/")
    out = rows.select("host", "shape", template.alias("template"), "labelled", "blocked")
    leaf = out.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    purity = (F.col("b") + limits.smooth * limits.prior) / (F.col("l") + limits.smooth)
    return out.select("host", "shape", "template").join(leaf.select("host", "template", purity.alias("purity")), ["host", "template"])


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, limits: Limits = Limits(), key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict, and the template that judged (null under a rule), one for each row.

    Null urls and urls without ``://`` have an empty host and path, and are judged by that
    template as any other.  Repeated rows are each judged, an empty table gives an empty one,
    and other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    text, verdict = matched(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": text, "said": verdict, "shape": shape(F.col("path"))})
    counts = rows.groupBy("host", "shape").agg(  # the partial sums leave one row a task for a hot shape
        F.count("*").alias("n"),
        F.count("said").alias("labelled"),
        F.count(F.when(F.col("said") == "block", 1)).alias("blocked"),
    )
    found = templates(counts, limits)
    out = rows.join(found, ["host", "shape"], "left")
    own = F.when(F.col("purity") >= limits.reject, "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.when(F.col("said").isNull(), F.col("template")).alias("template"))


def sql(rules: tuple[Rule, ...] = RULES, limits: Limits = Limits(), levels: int = 3) -> str:
    """The query over ``pages`` in DuckDB's SQL; below ``levels`` segments nothing is merged (production paths have two)."""
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.prefix}'))"
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    text, said = (" ".join(f"WHEN {fits(r)} THEN '{getattr(r, f)}'" for r in ranked) for f in ("text", "verdict"))
    form = lambda x: f"regexp_replace(regexp_replace({x}, '\\p{{L}}+', 'a', 'g'), '(?:a[-_])+a', 'a-a', 'g')"
    ctes = [
        "cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)",
        f"rows_ AS (SELECT *, CASE {text} END AS rule, CASE {said} END AS said, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM parts)",
        "counts AS (SELECT host, shape, count(*) AS n, count(said) AS labelled, count(CASE WHEN said = 'block' THEN 1 END) AS blocked FROM rows_ GROUP BY ALL)",
        "w0 AS (SELECT *, list_filter(string_split(shape, '/'), lambda x: x <> '') AS p, []::VARCHAR[] AS named FROM counts)",
    ]
    for k in range(levels):
        ctes += [
            f"d{k} AS (SELECT *, array_to_string(named, '/') AS prefix, p[{k + 1}] AS seg, {form(f"array_to_string(p[{k + 2}:], '/')")} AS form FROM w{k} WHERE len(p) > {k})",
            f"e{k} AS (SELECT host, prefix, seg, form, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM d{k} GROUP BY ALL)",
            f"c{k} AS (SELECT host, prefix, seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, max((n, form))[2] AS mode FROM e{k} GROUP BY ALL)",
            f"v{k} AS (SELECT host, prefix, TRUE AS wide FROM c{k} GROUP BY ALL HAVING count(*) > {limits.fan} AND sum(n::DOUBLE) ** 2 / sum(n::DOUBLE ** 2) > {limits.fan})",
            f"p{k} AS (SELECT host, prefix, mode, sum(n) AS nn, sum(labelled) AS ll, sum(blocked) AS bb FROM c{k} GROUP BY ALL)",
            f"m{k} AS (SELECT e.*, c.mode FROM e{k} e JOIN c{k} c USING (host, prefix, seg))",
            f"f{k} AS (SELECT host, prefix, mode, form, sum(n) AS f FROM m{k} GROUP BY ALL)",
            f"k{k} AS (SELECT host, prefix, mode, (count(*) - 1)::DOUBLE AS df FROM f{k} GROUP BY ALL)",
            f"s{k} AS (SELECT host, prefix, seg, sum(n::DOUBLE * n / f) AS squares FROM m{k} JOIN f{k} USING (host, prefix, mode, form) GROUP BY ALL)",
            f"j{k} AS (SELECT host, prefix, seg, mode, wide, wide IS NULL AND (df < 1 OR squares * nn / n - n <= df * (1 - 2 / (9 * df) + {limits.doubt} * sqrt(2 / (9 * df))) ** 3) "
            f"AND (labelled = 0 OR (blocked - labelled * bb / greatest(ll, 1)) ** 2 <= {limits.doubt**2} * labelled * (bb / greatest(ll, 1)) * (1 - bb / greatest(ll, 1)) + 1e-9) AS joins "
            f"FROM c{k} JOIN p{k} USING (host, prefix, mode) JOIN k{k} USING (host, prefix, mode) JOIN s{k} USING (host, prefix, seg) LEFT JOIN v{k} USING (host, prefix))",
            f"g{k} AS (SELECT host, prefix, mode, min(seg) AS least FROM j{k} WHERE joins GROUP BY ALL HAVING count(*) > 1)",
            f"n{k} AS (SELECT host, prefix, seg, CASE WHEN wide THEN '*' WHEN joins AND least IS NOT NULL THEN least || '~' ELSE seg END AS name FROM j{k} LEFT JOIN g{k} USING (host, prefix, mode))",
            f"w{k + 1} AS (SELECT host, shape, n, labelled, blocked, p, named FROM w{k} WHERE len(p) <= {k} UNION ALL SELECT host, shape, n, labelled, blocked, p, list_append(named, name) FROM d{k} JOIN n{k} USING (host, prefix, seg))",
        ]
    ctes += [
        f"named AS (SELECT host, shape, array_to_string(list_concat(named, p[len(named) + 1:]), '/') AS template, labelled, blocked FROM w{levels})",
        f"pure AS (SELECT host, template, (sum(blocked) + {limits.smooth * limits.prior}) / (sum(labelled) + {limits.smooth}) AS purity FROM named GROUP BY ALL)",
        "judge AS (SELECT host, shape, template, purity FROM named JOIN pure USING (host, template))",
    ]
    return (
        f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {limits.reject} THEN 'block' ELSE 'allow' END) AS verdict, "
        "CASE WHEN said IS NULL THEN template END AS template FROM rows_ LEFT JOIN judge USING (host, shape)"
    )
