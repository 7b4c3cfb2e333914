"""URL filter: longest-match rules, and boosted trees for the rest.

Gradient-boosted trees judge a url from lexical features alone (lengths,
depth, digit ratio, character entropy, parameter counts, hashed three-letter
pieces of the first folder) and from how often labelled urls with the same host
suffix, or the same first folder, are blocked.  They learn from the urls that a
rule labels and judge those that no rule fits.  These rates count every
labelled url; only the fit is of a sample.  A suffix or folder whose labelled
urls all have one verdict tells the rule, not the url, and counts as unknown.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import smallest_hashes, write_table

#: The given rules (host, path prefix, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bound of the training sample: the distinct labelled urls of the smallest hashes.
TRAIN_ROWS = 20_000
#: Hash buckets of the first folder's three-letter pieces.
GRAMS = 16
#: A sampled url's rates are of the hosts in the other folds.
FOLDS = 5
#: Rate of a suffix or folder that no labelled url has, or only urls of one verdict.
UNKNOWN = -1.0
TREES, DEPTH = 15, 4
SMOOTHING = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.regexp_extract(url, URL_PARTS, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  Of two rules
    equally long the smaller text wins."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical_features(url: str = "url", host: str = "host", path: str = "path") -> dict[str, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    letters = F.split(u, "")
    # every distinct character adds -p log2 p
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total - F.when(
        F.length(c) == 0, 0.0).otherwise((n - F.length(F.replace(u, c, F.lit("")))) / n * F.log2(
            F.greatest((n - F.length(F.replace(u, c, F.lit("")))) / n, F.lit(1e-12)))))
    return {
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": F.size(F.filter(F.split(F.col(path), "/"), lambda s: F.length(s) > 0)).cast("double"),
        "f_labels": F.size(F.split(F.col(host), r"\.")).cast("double"),
        "f_hyphens": (F.length(host) - F.length(F.translate(F.col(host), "-", ""))).cast("double"),
        "f_digit_ratio": (F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))) / n,
        "f_symbol_ratio": F.length(F.regexp_replace(u, "[A-Za-z0-9]", "")) / n,
        "f_entropy": entropy,
        "f_parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "f_query_length": F.length(query).cast("double"),
        "f_fragment": u.contains("#").cast("double"),
        "f_https": u.startswith("https://").cast("double"),
        "f_first_folder": F.length(F.regexp_extract(F.col(path), "^/([^/]*)", 1)).cast("double"),
        "f_file_suffix": F.length(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
    }


def first_folder(path: str = "path") -> Column:
    return F.translate(F.regexp_extract(F.col(path), "^/([^/]*)", 1), UPPER, LOWER)


def folder_pieces(path: str = "path") -> Column:
    """Hash buckets of the first folder's three-letter pieces, ends marked;
    linear in its length."""
    letters = F.split(F.concat(F.lit("^"), first_folder(path), F.lit("$")), "")
    joined = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    pieces = F.zip_with(F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), joined),
                        F.slice(letters, F.lit(3), F.size(letters)), joined)
    return F.array_distinct(F.transform(pieces, lambda p: F.pmod(F.xxhash64(p), F.lit(GRAMS)).cast("int")))


def suffix(host: str, labels: int) -> Column:
    return F.substring_index(F.col(host), ".", -labels)


def fold_of(host: str = "host") -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(host)), F.lit(FOLDS)).cast("int")


def verdict_counts(labelled: DataFrame, part: Column, name: str, tag: str) -> DataFrame:
    """(name, bad, n, folds; the last three with ``tag``): labelled rows by a
    part of the url, blocked and all, and the same by fold of the host."""
    by_fold = labelled.groupBy(part.alias(name), fold_of().alias("fold")) \
        .agg(F.sum("label").cast("long").alias("bad"), F.count("*").alias("n"))
    return by_fold.groupBy(name).agg(
        F.sum("bad").alias(f"bad{tag}"), F.sum("n").alias(f"n{tag}"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("bad", "n")))).alias(f"folds{tag}"))  # FOLDS at most


def suffix_counts(labelled: DataFrame, labels: int) -> DataFrame:
    return verdict_counts(labelled, suffix("host", labels), f"suffix{labels}", str(labels))


def verdict_rate(tag: str, share: float, out_of_fold: bool) -> Column:
    """Share of blocked urls, smoothed to the overall ``share``; out of fold it
    leaves out the host's own fold."""
    every, rest = [F.col(f"{c}{tag}") for c in ("bad", "n")], [F.col(f"{c}{tag}") for c in ("bad", "n")]
    if out_of_fold:
        own = F.col(f"folds{tag}")[fold_of()]
        rest = [r - F.coalesce(own[c], F.lit(0)) for r, c in zip(rest, ("bad", "n"))]
    rate = (rest[0] + SMOOTHING * share) / (rest[1] + SMOOTHING)
    return F.when((every[0] > 0) & (every[0] < every[1]), rate).otherwise(UNKNOWN)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH):
    """A judge: DataFrame with url, host, path -> the same with ``p_block``.

    ``labelled`` has url, host, path and label (1 block, 0 allow).  Rates are of
    all its rows; the fit sees the ``rows`` distinct urls of the smallest
    hashes, each with and without its known suffix rates and with and without
    its known folder rate (at most four times), so that an unknown rate is no
    sign of a verdict.  Without two classes the judge gives the one class it saw
    (allow, if none).
    """
    labelled = labelled.select("url", "host", "path", F.col("label").cast("double").alias("label"))
    seen = labelled.agg(F.avg("label")).first()[0]
    if seen in (None, 0.0, 1.0):
        return lambda df: df.withColumn("p_block", F.lit(seen or 0.0))
    hashed = labelled.withColumn("hash", F.xxhash64("url"))
    sample = write_table(smallest_hashes(hashed, "hash", rows).distinct().orderBy("hash", "url").limit(rows).drop("hash"), "url-sample")
    parts = {"suffix1": (suffix("host", 1), "1"), "suffix2": (suffix("host", 2), "2"), "folder": (first_folder(), "_folder")}
    # a part with one verdict has no rate, so its row is not needed
    stats = {name: write_table(verdict_counts(labelled, part, name, tag).where(f"bad{tag} > 0 and bad{tag} < n{tag}"), f"url-{name}")
             for name, (part, tag) in parts.items()}
    suffixes, folder = ["f_suffix1", "f_suffix2"], ["f_folder"]
    names = [*lexical_features(), *(f"f_piece{k}" for k in range(GRAMS)), *suffixes, *folder]

    def features(df: DataFrame, out_of_fold: bool) -> DataFrame:
        df = df.withColumn("pieces", folder_pieces()).withColumns(
            {f"f_piece{k}": F.array_contains("pieces", k).cast("double") for k in range(GRAMS)}).withColumns(lexical_features())
        for name, (part, tag) in parts.items():
            df = df.withColumn(name, part).join(stats[name], name, "left") \
                .withColumn(f"f_{name}", verdict_rate(tag, seen, out_of_fold))
        return df

    def without(df: DataFrame, rates: list[str]) -> DataFrame:
        """Rows of ``df`` that know one of ``rates``, as if they did not."""
        return df.where(" or ".join(f"{r} <> {UNKNOWN}" for r in rates)).withColumns({r: F.lit(UNKNOWN) for r in rates})

    assemble = VectorAssembler(inputCols=names, outputCol="features")
    rated = write_table(features(sample, True).select(*names, "label"), "url-rated")
    shown = rated.unionByName(without(rated, suffixes))
    shown = shown.unionByName(without(shown, folder))
    fitted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=42) \
        .fit(assemble.transform(shown).select("features", "label").coalesce(2))

    def judge(df: DataFrame) -> DataFrame:
        scored = fitted.transform(assemble.transform(features(df, False)))
        return scored.withColumn("p_block", vector_to_array("probability")[1]).select(*df.columns, "p_block")

    return judge


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, p_block
    (null where a rule decides).

    A null url, or one without ``://``, has empty host and path, fits no rule
    and is judged by the trees like any other.  Repeated rows and null ids come
    back as they came.  An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")) \
        .select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "by_rule": verdict})
    labelled = ruled.where("rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("int"))
    scored = train(labelled, rows)(ruled)
    by_method = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("p_block")).alias("p_block"))
