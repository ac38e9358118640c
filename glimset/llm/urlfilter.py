"""URL filter: rules, and gradient-boosted trees on lexical features for the URLs that none fits.

A rule is (host, path, verdict); it fits its host and all subdomains if the URL's path starts with
the rule's, and of several that fit, the longest decides (of equal length: the longer host, then the
verdict ``block``). Rules may be a table of any size: a URL's host suffixes are joined with it, one
join for each number of labels that a rule's host has.

The trees learn from labelled URLs, given by the caller; else those that the rules decide are the
labelled ones, as a rule's verdict is the only one that is known for a URL. Statistics of suffixes (the
host's last label and last two labels, the path's first part and its file's ending: how many labelled
URLs have it, and how many of them are to be blocked) are taken out of fold, with whole hosts in a
fold, so that the trees learn how far a suffix can be trusted on hosts that are new. ``held_out_hosts``
measures just that. Everything is DataFrame expressions: features, bins, histograms (an aggregate a
level, of integer gradients, so that no order of rows matters) and the trees themselves. The driver
only sees histograms, whose size is leaves x features x bins.

What is learnt has a bound: ``sample_rows`` distinct labelled URLs, those first by a hash of the URL.
What is judged is every URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule fits it and
the trees judge its features; URLs without a host teach nothing; a URL with both labels is to be
blocked; without labelled URLs the trees allow everything; repeated rows are judged each; other columns
are carried in ``row`` whatever their names are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SUFFIXES = ("top", "site", "section", "ending")
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens")
FEATURES = [*LEXICAL, *(f"{s}_{k}" for s in SUFFIXES for k in ("rows", "rate"))]
UNIT = 1_000_000
FOLDS = 5
#: Rows without a block that are added to those of a suffix: one that is hardly known speaks for no block.
PRIOR_ROWS = 5.0


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds __host and __path of the column ``url``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.col(url).substr(F.instr(F.col(url), "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"__host": F.translate(host, UPPER, LOWER), "__path": path})


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A list of rules as a table (host, path, verdict)."""
    rows = [F.struct(*(F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), r, strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.sql("SELECT '' AS host, '' AS path, '' AS verdict").limit(0)


def with_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds __rule (host and path) and __verdict of the rule that decides __host and __path; null if none fits."""
    rules = rules.withColumn("__labels", F.size(F.split("host", r"\."))).filter("host <> ''")
    depths = [r[0] for r in rules.select("__labels").distinct().orderBy("__labels").collect()]
    best: list[Column] = []
    for k in depths:
        one = F.struct(F.length("path").alias("n"), F.col("path").alias("path"), (F.col("verdict") == "block").alias("blocks"))
        # the rules of a host by length of their paths, so that the first that fits is the longest
        own = rules.filter(F.col("__labels") == k).groupBy(F.col("host").alias(f"__host{k}")).agg(F.sort_array(F.collect_set(one), asc=False).alias(f"__rules{k}"))
        df = df.join(own, F.substring_index("__host", ".", -k) == F.col(f"__host{k}"), "left")
        fits = F.get(F.filter(f"__rules{k}", lambda r: F.col("__path").startswith(r["path"])), 0)
        best.append(F.when(fits.isNotNull(), F.struct((F.length(f"__host{k}") + fits["n"]).alias("n"), F.lit(k).alias("labels"), F.concat(f"__host{k}", fits["path"]).alias("rule"), fits["blocks"].alias("blocks"))))
    if not best:
        return df.withColumns({"__rule": F.lit(None).cast("string"), "__verdict": F.lit(None).cast("string")})
    first = F.greatest(*best) if len(best) > 1 else best[0]
    df = df.withColumn("__best", first)
    df = df.withColumns({"__rule": F.col("__best.rule"), "__verdict": F.when(F.col("__best.blocks"), "block").when(~F.col("__best.blocks"), "allow")})
    return df.drop("__best", *(f"__{c}{k}" for k in depths for c in ("host", "rules")))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features of ``url`` (all but the statistics of suffixes) and the suffixes themselves."""
    text = F.coalesce(F.col(url), F.lit(""))
    chars = F.array_distinct(F.split(F.col("__host"), ""))
    n = F.greatest(F.length("__host"), F.lit(1)).cast("double")
    share = lambda c: (F.length("__host") - F.length(F.replace(F.col("__host"), c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    count = lambda what: F.regexp_count(text, F.lit(what)).cast("double")
    return df.withColumns(
        {
            "url_length": F.length(text).cast("double"), "host_length": F.length("__host").cast("double"), "path_length": F.length("__path").cast("double"),
            "depth": F.regexp_count(F.col("__path"), F.lit("/")).cast("double"), "labels": F.regexp_count(F.col("__host"), F.lit(r"\.")).cast("double"),
            "digit_ratio": count("[0-9]") / F.greatest(F.length(text), F.lit(1)), "entropy": F.round(entropy, 6), "parameters": count("[?&][^=&#?]+="), "hyphens": count("-"),
            "top": F.substring_index(F.col("__host"), ".", -1), "site": F.substring_index(F.col("__host"), ".", -2),
            "section": F.regexp_extract("__path", "^(/[^/]*)", 1), "ending": F.regexp_extract("__path", "([.][A-Za-z0-9]+)$", 1),
        }
    )


def case_of(tree: dict, features: Sequence[str]) -> Column:
    """A tree as an expression: {"value": v} or {"feature", "cut", "left", "right"}."""
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(features[tree["feature"]]) <= F.lit(tree["cut"]), case_of(tree["left"], features)).otherwise(case_of(tree["right"], features))


def _array(values: Sequence[float]) -> str:
    """SQL of an array of numbers."""
    return f"array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})"


def boost(sample: DataFrame, features: Sequence[str], trees: int = 4, depth: int = 3, bins: int = 16, rate: float = 0.7, l2: float = 1.0, least: int = 5) -> tuple[float, list[dict]]:
    """(base, trees) for a table of the features and label (0 or 1), by logistic loss.

    Rows are binned and written once, with their margin before the last tree in reach of one expression:
    trees are arrays of split features, bins and leaf values that the rows walk down. A tree costs
    ``depth`` aggregates: of gradients and second derivatives, in millionths, by leaf so far, feature and
    bin; the values of the last leaves follow from the last level's sums."""
    parts = [k / bins for k in range(1, bins)]
    n, positive, *found = sample.agg(F.count(F.lit(1)), F.sum("label"), *[F.percentile_approx(f, parts, 10_000) for f in features]).first()
    if not n or not 0 < positive < n:
        return (-30.0 if not positive else 30.0), []
    base = math.log(positive / (n - positive))
    cuts = [sorted({float(x) for x in c}) for c in found]
    index = lambda f: F.expr(f"size(filter({_array(cuts[f])}, c -> {features[f]} > c))")
    # rows that look alike are one, with a count
    rows = written(sample.select(F.array(*[index(f) for f in range(len(features))]).alias("b"), F.col("label").cast("int").alias("label")).groupBy("b", "label").agg(F.count(F.lit(1)).alias("n")), "url-bins")
    nodes = 2**depth - 1
    split: list[int] = []
    at_bin: list[int] = []
    leaves: list[float] = []

    def walk(tree: Column, feature: Column, cut: Column, levels: int) -> Column:
        """The node, from 0, that a row reaches in so many levels of a tree, given the tree's first place in the arrays."""
        at = F.lit(0)
        for _ in range(levels):
            at = 2 * at + 1 + (F.get("b", F.get(feature, tree + at)) > F.get(cut, tree + at)).cast("int")
        return at

    forest: list[dict] = []
    for t in range(trees):
        margin = F.lit(base)
        if t:
            feature, cut, value = (F.expr(_array(x)) for x in (split, at_bin, leaves))
            margin = F.aggregate(F.expr(_array(range(t))), margin, lambda m, k: m + F.get(value, k * (nodes + 1) + walk(k * nodes, feature, cut, depth) - nodes))
        at_margin = rows.select("b", "label", "n", (1 / (1 + F.exp(-margin))).alias("p"))
        g, h = (F.round(x * UNIT).cast("long") * F.col("n") for x in (F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p"))))
        own_split, own_bin = [0] * nodes, [10**6] * nodes
        values = {0: 0.0}
        for level in range(depth):
            leaf = walk(F.lit(0), F.expr(_array(own_split)), F.expr(_array(own_bin)), level)
            sums = at_margin.select(leaf.alias("leaf"), g.alias("g"), h.alias("h"), "n", F.posexplode("b").alias("f", "bin")).groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            table = {(r.leaf, r.f, r.bin): (r.g / UNIT, r.h / UNIT, r.n) for r in sums}
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                whole = [sum(table.get((node, 0, b), (0, 0, 0))[i] for b in range(bins + 1)) for i in range(3)]
                best = (1e-6, -1, -1, whole)
                for f in range(len(features)):
                    left = [0.0, 0.0, 0]
                    for b in range(len(cuts[f])):
                        left = [x + y for x, y in zip(left, table.get((node, f, b), (0, 0, 0)), strict=True)]
                        right = [x - y for x, y in zip(whole, left, strict=True)]
                        if min(left[2], right[2]) >= least:
                            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, f, b, list(left))
                worth = lambda x: -rate * x[0] / (x[1] + l2)
                if best[1] >= 0:
                    own_split[node], own_bin[node] = best[1], best[2]
                    values[2 * node + 1], values[2 * node + 2] = worth(best[3]), worth([x - y for x, y in zip(whole, best[3], strict=True)])
                else:  # all rows go left
                    values[2 * node + 1] = values[2 * node + 2] = worth(whole)
        split += own_split
        at_bin += own_bin
        leaves += [values[nodes + k] for k in range(nodes + 1)]

        def tree(node: int, own_split=own_split, own_bin=own_bin, values=values) -> dict:
            if node >= nodes:
                return {"value": values[node]}
            if own_bin[node] >= 10**6:
                return tree(2 * node + 1)
            return {"feature": own_split[node], "cut": float(cuts[own_split[node]][own_bin[node]]), "left": tree(2 * node + 1), "right": tree(2 * node + 2)}

        forest.append(tree(0))
    return base, forest


class UrlModel:
    """The trees, and the statistics of suffixes that they see."""

    def __init__(self, statistics: dict[str, DataFrame], base: float, forest: list[dict]):
        self.statistics, self.base, self.forest = statistics, base, forest

    def with_probability(self, df: DataFrame, url: str) -> DataFrame:
        """Adds __block, the probability that a URL is to be blocked, to rows that have been through ``with_parts``."""
        margin = sum((case_of(t, FEATURES) for t in self.forest), F.lit(self.base))
        columns = df.columns
        for s in SUFFIXES:
            # at most sample_rows suffixes, so that the broadcast has that bound
            df = df if s in df.columns else lexical(df, url)
            df = df.join(F.broadcast(self.statistics[s].withColumnRenamed("suffix", f"__{s}")), F.col(s) == F.col(f"__{s}"), "left").drop(f"__{s}")
            df = df.withColumns({f"{s}_rows": F.coalesce(f"{s}_rows", F.lit(0.0)), f"{s}_rate": F.coalesce(f"{s}_rate", F.lit(0.0))})
        return df.withColumn("__block", 1 / (1 + F.exp(-margin))).select(*columns, "__block")


def fit(labelled: DataFrame, sample_rows: int = 20_000, **options) -> UrlModel:
    """Learns from (url, label 0 or 1)."""
    known = with_parts(labelled.select(F.col("url").alias("__url"), F.col("label").cast("int").alias("label")), "__url").filter("__host <> '' AND label IS NOT NULL")
    some = known.groupBy("__url", "__host", "__path").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__url"), "__url").limit(sample_rows)
    some = written(lexical(some, "__url").withColumn("fold", F.pmod(F.xxhash64("__host"), F.lit(FOLDS)).cast("int")), "url-sample")
    rate = lambda y, rows: F.col(y) / (F.col(rows) + PRIOR_ROWS)
    # each suffix of each kind, by fold, in one aggregate
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in SUFFIXES])).alias("x")
    parts = some.select("fold", "label", kinds).groupBy("x.kind", "x.suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    whole = parts.groupBy("kind", "suffix").agg(F.sum("n").alias("n_all"), F.sum("y").alias("y_all"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "y")))).alias("own"))
    whole = written(whole, "url-suffixes")
    train = some
    for s in SUFFIXES:
        of = whole.filter(F.col("kind") == s).select(F.col("suffix").alias(f"__{s}"), "n_all", "y_all", "own")
        train = train.join(F.broadcast(of), F.col(s) == F.col(f"__{s}"))
        train = train.withColumns({"__n": F.col("n_all") - F.col("own")[F.col("fold")]["n"], "__y": F.col("y_all") - F.col("own")[F.col("fold")]["y"]})
        train = train.withColumns({f"{s}_rows": F.log1p("__n"), f"{s}_rate": rate("__y", "__n")}).drop("n_all", "y_all", "own", "__n", "__y", f"__{s}")
    statistics = {s: whole.filter(F.col("kind") == s).select("suffix", F.log1p(F.col("n_all") * (1 - 1 / FOLDS)).alias(f"{s}_rows"), rate("y_all", "n_all").alias(f"{s}_rate")) for s in SUFFIXES}
    base, forest = boost(written(train.select("label", *FEATURES), "url-features"), FEATURES, **options)
    return UrlModel(statistics, base, forest)


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, label) of the URLs that rules decide."""
    df = with_rules(with_parts(pages.select(F.col("url").cast("string").alias("__url")), "__url"), rules)
    return df.filter("__verdict IS NOT NULL").select(F.col("__url").alias("url"), (F.col("__verdict") == "block").cast("int").alias("label"))


def held_out_hosts(labelled: DataFrame, **options) -> tuple[int, int, int]:
    """(right, all, blocked) over the labelled URLs of a quarter of the hosts, judged by trees that learnt from the others."""
    known = with_parts(labelled.withColumn("__url", F.col("url")), "__url")
    mine = F.crc32("__host") % 4 == 2
    model = fit(known.filter(~mine).select("url", "label"), **options)
    judged = model.with_probability(known.filter(mine), "__url")
    said = (F.col("__block") >= 0.5).cast("int")
    return tuple(judged.agg(F.count_if(said == F.col("label")), F.count(F.lit(1)), F.count_if(said == 1)).first())


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, keep: Sequence[str] = ("page_id",), labelled: DataFrame | None = None, **options) -> DataFrame:
    """row (a struct of the columns ``keep``), and host, path, rule, verdict and p_block (null where a rule decides) of each url.

    ``labelled``: (url, label), 1 for URLs to be blocked; else those that the rules decide."""
    rules = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    model = fit(ruled(pages, rules) if labelled is None else labelled, **options)
    df = with_parts(pages.select(F.struct(*keep).alias("row"), F.col("url").cast("string").alias("__url")), "__url")
    judged = model.with_probability(with_rules(df, rules), "__url")
    verdict = F.coalesce("__verdict", F.when(F.col("__block") >= 0.5, "block").otherwise("allow"))
    return judged.select("row", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__verdict").isNull(), F.col("__block")).alias("p_block"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("row.*", "host", "path", "rule", "verdict", "p_block")


QUERIES = {"op5_urlfilter": op5_urlfilter}
ORACLES: dict[str, str] = {}
