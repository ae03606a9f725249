"""URL filter: host and path rules, and gradient-boosted trees for all other URLs.

Rules label every URL that one of them fits; the trees learn from these.  Their
features are lexical: length, depth, digit ratio, character entropy, parameter
count, label count, hyphens, and the suffix statistics (the smoothed block rate
of the host's last label and of the path's first segment among all labelled URLs).

Everything is DataFrame expressions.  The rates are counted over every labelled
row.  Those of keys that hold `HEAVY` of the rows or more, a bounded number, are an
expression; all others are joined by key, so no key is a large part of that join.
Training rows, about `max_rows` of either label at most (those whose URL's hash is
below a bound), are binned and summed per distinct bin vector; each level of a tree
is one aggregation to a histogram of gradients per node, feature and bin, and only
that histogram, of fixed size, comes to the driver, where the splits are chosen.
The finished trees are one expression over the bins.

Defined cases: a null URL or one without "://" has an empty host and path and is
judged by the trees; without labelled URLs of both kinds the trees' verdict is
the kind that exists, else allow; ties between rules go to the longest, then the
last listed; ties between splits to the first feature and edge; repeated rows are
each judged; an empty table gives no rows.  All other columns are kept, whatever
their names; only ones named host, path, rule or verdict are replaced.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut

#: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix_rate", "segment_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path of a URL; both empty without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one string) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule = F.when(fits, F.lit(r_host + r_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r_verdict)).otherwise(verdict)
    return rule, verdict


#: The share of labelled rows from which a key's rate is part of the expression.
HEAVY = 0.01


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the features of the URL, and the keys of its suffix statistics, to (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    chars = F.length(url)
    counts = [chars - F.length(F.translate(url, c, "")) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#=&%"]
    entropy = sum((F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0) for n in counts), F.lit(0.0))
    safe = F.greatest(chars, F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.select(
        "*",
        chars.cast("double").alias("length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        ((chars - F.length(F.translate(url, "0123456789", ""))) / safe).alias("digits"),
        (F.log2(safe) - entropy / safe).alias("entropy"),
        F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")).alias("parameters"),
        (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).cast("double").alias("labels"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.regexp_extract("path", r"(?s)^/([^/]*)", 1).alias("segment"),
    )


class Rates:
    """Block rates by key over all labelled rows (key, y), smoothed to the overall rate."""

    def __init__(self, labelled: DataFrame, key: str):
        n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        self.key, self.prior = key, bad / n if n else 0.5
        counts = labelled.groupBy(F.col(key).alias("r_key")).agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
        counts = cut(counts.select("r_key", "n", ((F.col("bad") + 5 * self.prior) / (F.col("n") + 5)).alias("r_rate")))
        heavy = F.col("n") >= HEAVY * n
        self.heavy = {r.r_key: r.r_rate for r in counts.filter(heavy).collect()}  # at most 1 / HEAVY rows
        self.others = counts.filter(~heavy).select("r_key", "r_rate")

    def join(self, df: DataFrame) -> DataFrame:
        """`df` with the rate of its key as <key>_rate."""
        name = f"{self.key}_rate"
        if not self.heavy:
            return df.withColumn(name, F.lit(self.prior))
        rates = F.create_map(*(F.lit(x) for pair in sorted(self.heavy.items()) for x in pair))
        known = F.try_element_at(rates, F.col(self.key))
        # Rows that need no join are spread over keys that no URL has.
        look = F.when(known.isNull(), F.col(self.key)).otherwise(F.concat(F.lit("/"), F.pmod(F.xxhash64("url"), F.lit(4096).cast("long")).cast("string")))
        joined = df.withColumn("look", look).join(self.others, F.col("look") == F.col("r_key"), "left")
        return joined.withColumn(name, F.coalesce(known, "r_rate", F.lit(self.prior))).drop("look", "r_key", "r_rate")


class Trees:
    """Boosted trees over bin numbers: `edges` by feature, `trees` as lists of nested splits."""

    def __init__(self, edges, base, trees):
        self.edges, self.base, self.trees = edges, base, trees

    def bins(self, df: DataFrame) -> DataFrame:
        for name in FEATURES:
            bin_of = sum((F.when(F.col(name) > e, 1).otherwise(0) for e in self.edges[name]), F.lit(0))
            df = df.withColumn(f"b_{name}", bin_of)
        return df

    def margin(self) -> Column:
        return sum((_value(t) for t in self.trees), F.lit(self.base))


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, edge, left, right = tree
    return F.when(F.col(f"b_{name}") <= edge, _value(left)).otherwise(_value(right))


def _node(tree, depth=0, number=1) -> Column:
    """The number of the leaf that a row falls into."""
    if not isinstance(tree, tuple):
        return F.lit(number)
    name, edge, left, right = tree
    return F.when(F.col(f"b_{name}") <= edge, _node(left, depth + 1, 2 * number)).otherwise(_node(right, depth + 1, 2 * number + 1))


def _grow(tree, number, splits):
    if not isinstance(tree, tuple):
        return splits.get(number, tree)
    name, edge, left, right = tree
    return name, edge, _grow(left, 2 * number, splits), _grow(right, 2 * number + 1, splits)


def fit(labelled: DataFrame, rounds: int = 8, depth: int = 3, rate: float = 0.5, n_bins: int = 16, least: float = 1.0, least_gain: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss; `labelled` has FEATURES and y (0 or 1), and a bounded number of rows.

    A split needs `least` of curvature on either side and more than `least_gain` of gain; without one, boosting ends.
    """
    quantiles = labelled.agg(*(F.percentile_approx(n, [k / n_bins for k in range(1, n_bins)], 1000).alias(n) for n in FEATURES)).first()
    edges = {n: sorted(set(quantiles[n] or [])) for n in FEATURES}
    model = Trees(edges, 0.0, [])
    binned = [f"b_{n}" for n in FEATURES]
    # No more rows than the sample: in one partition, so that the histogram of a level is one small task.
    data = cut(model.bins(labelled).groupBy(*binned).agg(F.count("*").alias("n"), F.sum("y").alias("bad")).coalesce(1))
    n, bad = data.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    model.base = math.log((bad + 0.5) / (n - bad + 0.5)) if n else -1.0
    if not 0 < bad < n:
        return model
    for _ in range(rounds):
        tree = 0.0
        p = 1 / (1 + F.exp(-F.least(F.greatest(model.margin(), F.lit(-30.0)), F.lit(30.0))))
        for level in range(depth):
            splits = _splits(data.select("*", _node(tree).alias("node"), (F.col("bad") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h")), binned, 1 << level, rate, least, least_gain)
            if not splits:
                break
            tree = _grow(tree, 1, splits)
        if not isinstance(tree, tuple):
            break  # nothing is left to learn
        model.trees.append(tree)
    return model


def _splits(rows: DataFrame, binned, first, rate, least, least_gain):
    """The best split of each node of a level, as {node: (feature, edge, value, value)}."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(b).alias("bin")) for i, b in enumerate(binned))))
    found = rows.filter(F.col("node") >= first).select("node", "g", "h", pairs.alias("x")).groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    table = {}
    for r in found:
        table.setdefault(r.node, {}).setdefault(r.f, []).append((r.bin, r.g, r.h))
    out = {}
    for node, features in sorted(table.items()):
        best = None
        for f, bins in sorted(features.items()):
            bins.sort()
            g, h = sum(b[1] for b in bins), sum(b[2] for b in bins)
            left_g = left_h = 0.0
            for edge, x, y in bins[:-1]:
                left_g, left_h = left_g + x, left_h + y
                right_g, right_h = g - left_g, h - left_h
                if min(left_h, right_h) < least:
                    continue
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g**2 / (h + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, FEATURES[f], edge, rate * left_g / (left_h + 1), rate * right_g / (right_h + 1)
        if best and best[0] > least_gain:
            out[node] = best[1:]
    return out


def classify(pages: DataFrame, url: str = "url", rules=RULES, max_rows: int = 20_000, **options) -> DataFrame:
    """`pages` plus host, path, rule and verdict; its own columns travel in a struct, so no name clashes."""
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    held = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(url).cast("string").alias("url"))
    held = held.select("*", *(c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"))))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    held = held.select("*", rule.alias("rule"), verdict.alias("ruled"))
    labelled = held.filter(F.col("rule").isNotNull()).select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("y"))
    labelled = _lexical(labelled)
    rates = [Rates(labelled.select(key, "y"), key) for key in ("suffix", "segment")]

    def rated(df):
        for r in rates:
            df = r.join(df)
        return df

    totals = labelled.agg(*(F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1))).first()
    share = F.when(F.col("y") == 1, min(1.0, max_rows / max(1, totals.n1))).otherwise(min(1.0, max_rows / max(1, totals.n0)))
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share * (1 << 20))
    model = fit(cut(rated(sample)), **options)
    scored = model.bins(rated(_lexical(held)))
    out = scored.select("own.*", "host", "path", "rule", F.coalesce("ruled", F.when(model.margin() > 0, "block").otherwise("allow")).alias("verdict"))
    return out


def report(pages: DataFrame, **options) -> DataFrame:
    """page_id, host, path, rule and verdict of every page row; cases as in the module's docstring."""
    return classify(pages.select("page_id", "url"), **options).select("page_id", "host", "path", "rule", "verdict")
