"""Mixing sources to target weights by soft membership, on DataFrame functions alone.

A naive Bayes classifier over hashed words learns the domains from labelled rows and gives every document a posterior
over them. Document rates r >= 0 are then fitted by projected gradient least squares, so that for each domain d the sum
of r * tokens * p(d) meets the domain's share of the token budget. A pass over the documents is one aggregation that returns
as many numbers as there are pairs of domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import materialise, table

BUCKETS = 4096
#: Bound of the labelled sample; the rows with the smallest hashes of doc_id are taken.
MAX_TRAIN_ROWS = 20_000
#: Words beyond this many make a text no surer: the evidence is the mean of its words times their number, up to this.
EVIDENCE = 32.0
#: The targets are met within the first share of the budget; below the second a gradient moves nothing any more.
TOLERANCE, FLAT = 1e-6, 1e-9
#: Passes over the documents at most, and the shortest step that is tried.
MAX_PASSES, SHORTEST = 100, 1e-6
#: Weight of the rates' distance to 1 beside the squares of the misses.
NEAR = 1e-9
#: Most domains: the system has as many rows, and a row of posteriors as many columns.
MAX_DOMAINS = 64


def words(text: Column) -> Column:
    """The words of a text between spaces and line feeds, as rows; one empty word for a text without words."""
    return F.explode(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " "))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], DataFrame]:
    """Domains in order, and (bucket, w): a word's log-likelihood in each domain; BUCKETS rows.

    labelled: doc_id, domain; rows without either are left out, a doc_id with several domains takes the first by name.
    """
    named = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    counts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", words(F.col("text")).alias("word")).where("word <> ''").groupBy("domain", bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "domain-words")
    sums = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(sums)
    if not domains:
        return [], counts
    seen = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    logs = [F.log((F.coalesce(f"n{i}", F.lit(0)) + 0.5) / (sums[d] + 0.5 * BUCKETS)).alias(f"w{i}") for i, d in enumerate(domains)]
    return domains, materialise(every.join(seen, "bucket", "left").select("bucket", *logs), "domain-weights")


def memberships(docs: DataFrame, domains: list[str], weights: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, tokens, p0, p1 ...; rows with equal doc_id and source are one document.

    Texts without words have no tokens and equal posteriors.
    """
    k = range(len(domains))
    each = docs.select("doc_id", "source", words(F.col("text")).alias("word"))
    each = each.select("doc_id", "source", (F.col("word") != "").cast("int").alias("one"), bucket(F.col("word")).alias("bucket"))
    # weights has BUCKETS rows, whatever the input
    sums = each.join(F.broadcast(weights), "bucket").groupBy("doc_id", "source").agg(F.sum("one").alias("tokens"), *(F.sum(F.col(f"w{i}") * F.col("one")).alias(f"s{i}") for i in k))
    scale = F.least(F.col("tokens").cast("double"), F.lit(EVIDENCE)) / F.greatest("tokens", F.lit(1))
    top = F.greatest(*(F.col(f"s{i}") for i in k)) if len(domains) > 1 else F.col("s0")
    odds = sums.select("doc_id", "source", "tokens", *(F.exp((F.col(f"s{i}") - top) * scale).alias(f"e{i}") for i in k))
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return odds.select("doc_id", "source", "tokens", *(F.round(F.col(f"e{i}") / total, 9).alias(f"p{i}") for i in k))


def solved(m: list[list[float]], v: list[float]) -> list[float]:
    """x with m x = v for a positive definite m with a row for each domain, by elimination."""
    rows = [[*row, x] for row, x in zip(m, v, strict=True)]
    n = len(rows)
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for r in range(i + 1, n):
            share = rows[r][i] / rows[i][i]
            if share:
                rows[r] = [a - share * b for a, b in zip(rows[r], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """soft and rate: document rates, 1 at first, such that expected domain tokens are the targets' shares of budget.

    budget: tokens in all, those of soft if None. Domains without a target get zero; targets of domains that aren't there
    are left out and the others scaled up. Where no rates meet the targets, the rates are the least squares fit; of many
    that fit, those nearest to 1. miss: by how much the worst domain misses its target, as a share of the budget. Documents
    without tokens keep rate 1. No rows: no rows. More than MAX_DOMAINS domains: ValueError.

    Projected gradient: y sums up the gradients in the domains, and a document's rate is 1 - p . y, projected on what isn't
    negative. A gradient is scaled by the inverse of the domain matrix of the documents whose rate isn't zero, and halved
    until the squares fall. The iteration ends when the targets are met to TOLERANCE or the gradient is below FLAT, and after
    MAX_PASSES over soft whatever is reached; miss tells how far that is. A pass is one aggregation, nothing is written.
    """
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"at most {MAX_DOMAINS} domains")
    k = range(len(domains))
    p = [F.col(f"p{i}") for i in k]
    t = F.col("tokens").cast("double")
    tokens = soft.agg(F.sum(t).alias("all")).first()["all"]
    known = sum(targets.get(d, 0.0) for d in domains)
    if not tokens or known <= 0:
        return soft.withColumn("rate", F.lit(1.0)).withColumn("miss", F.lit(0.0))
    scale = (budget or tokens) / tokens
    goal = [targets.get(d, 0.0) / known for d in domains]
    w = t / F.lit(float(tokens) * scale)

    def rate(y: list[float]) -> Column:
        return F.greatest(F.lit(0.0), sum((p[i] * -y[i] for i in k), F.lit(1.0)))

    def passed(y: list[float]) -> tuple[float, list[float], list[float], list[list[float]]]:
        """Squares, gradient, misses and the domain matrix of free documents at y."""
        r = F.col("_r")
        free = F.when(r > 0, w).otherwise(0.0)
        got = soft.withColumn("_r", rate(y)).agg(
            F.sum(w * r * r).alias("squares"), *(F.sum(w * r * p[i]).alias(f"x{i}") for i in k), *(F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in k for j in k if i <= j)
        ).first()
        off = [got[f"x{i}"] - goal[i] for i in k]
        value = NEAR / 2 * sum(v * v for v in y) + got["squares"] / 2 + sum(v * g for v, g in zip(y, goal, strict=True))
        return value, [NEAR * v - o for v, o in zip(y, off, strict=True)], off, [[got[f"m{min(i, j)}_{max(i, j)}"] + (NEAR if i == j else 0.0) for j in k] for i in k]

    y, passes = [0.0 for _ in k], 1
    value, gradient, off, matrix = passed(y)
    while max(map(abs, off)) > TOLERANCE and max(map(abs, gradient)) > FLAT and passes < MAX_PASSES:
        move = solved(matrix, gradient)
        slope, step = sum(a * b for a, b in zip(move, gradient, strict=True)), 1.0
        while passes < MAX_PASSES and step > SHORTEST:
            passes += 1
            tried = [v - step * m for v, m in zip(y, move, strict=True)]
            new = passed(tried)
            if new[0] <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        y, (value, gradient, off, matrix) = tried, new
    fitted = F.when(t > 0, rate(y)).otherwise(1.0)
    return soft.withColumn("rate", fitted).withColumn("miss", F.lit(max(map(abs, off))))


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole numbers with the rate as their mean: rounded up for the share of ids whose hash is small."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def posterior_names(domains: list[str]) -> list[str]:
    """A column name for each domain, unlike the others whatever their case."""
    out: list[str] = []
    for d in domains:
        name = plain = "p_" + "".join(c if c.isalnum() else "_" for c in d)
        n = 1
        while name.lower() in (x.lower() for x in out):
            n += 1
            name = f"{plain}_{n}"
        out.append(name)
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, n_tokens, the posterior of each domain, rate, copies, miss.

    One row for each document (rows with equal doc_id and source are one). Without any labelled row all rates are 1.
    Columns named p_<domain> hold the posteriors; letters and digits of the domain stay, and of names that would be alike
    the later ones in order get a number. miss: see fit_rates.
    """
    docs = docs.select("doc_id", "source", "text")
    domains, weights = train(docs, labelled)
    if not domains:
        counted = docs.select("doc_id", "source", words(F.col("text")).alias("word")).groupBy("doc_id", "source").agg(F.sum((F.col("word") != "").cast("long")).alias("n_tokens"))
        return counted.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long")).withColumn("miss", F.lit(0.0))
    soft = materialise(memberships(docs, domains, weights), "memberships")
    rated = fit_rates(soft, domains, targets, budget)
    posteriors = [F.round(f"p{i}", 6).alias(name) for i, name in enumerate(posterior_names(domains))]
    rate = F.round("rate", 6)
    return rated.select("doc_id", "source", F.col("tokens").cast("long").alias("n_tokens"), *posteriors, rate.alias("rate"), copies(rate, F.col("doc_id")).alias("copies"), "miss")


#: Shares of tokens by language in the mixture of the queries.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the table of labels names, with their language as domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix(docs, labelled_domains(docs, labels), TARGETS)
