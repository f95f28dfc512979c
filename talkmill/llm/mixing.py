"""Mixing to target weights with soft membership; DataFrame functions only.

A naive Bayes classifier over the telling words is counted from the labelled documents and gives every
document its domain posteriors. Document rates r >= 0 then minimise

    sum_k (sum_d r_d n_d p_dk - t_k)^2 / c_k

(n: tokens, p: posteriors, t: targets, c: expected tokens at rate 1) by projected gradient steps.
Divided by n_d and c_k the problem has largest eigenvalue 1, so a step of 1 always descends:

    r_d <- max(0, r_d - sum_k p_dk (s_k - t_k) / c_k)

A step needs only the K sums s_k, one small aggregate over the slim table (tokens, posteriors,
rate). Sums are taken over integers, so they do not depend on the order of rows. The rates are
written to the shared folder every few steps, which cuts the lineage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import free_name, same, staged

#: Hash buckets of words: the model has at most BUCKETS rows, whatever the corpus.
BUCKETS = 1 << 20
#: Log-likelihoods are kept in integers of this fraction.
SCALE = 1_000_000
#: A word tells something when a domain is this many deviations and this many times more frequent with it.
LEAST_SURPRISE, LEAST_LIFT = 5.0, 3.0
#: Labelled texts that smooth the share of a domain among the texts with a word.
SMOOTHING = 1.0
#: Steps between two writes of the rates.
STEPS_PER_WRITE = 8
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of letters and runs of other signs: marks and tables tell as much as words.
FEATURE = r"\p{L}+|[^\p{L}\x20\x09-\x0D]+"


def _features(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(FEATURE), F.lit(0)))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain") -> tuple[DataFrame, list[int]]:
    """Word table (bucket, w0, w1, ...) and log priors, in units of 1/SCALE nats.

    A weight is the log of how much more often a domain is seen among labelled texts with the word
    than among all. Only telling words are kept: rare ones add noise, and common ones that lean a little
    to a domain (because its texts are longer, say) would outweigh the rest of a long text.
    """
    k = range(len(domains))
    of = [F.col(domain_col) == d for d in domains]
    docs = labelled.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)]).first()
    shares = [(docs[i] + 0.5) / (sum(docs) + 0.5 * len(domains)) for i in k]
    word = labelled.select(domain_col, F.explode(_features(F.col(text_col))).alias("w")).select(domain_col, _bucket(F.col("w")).alias("bucket"))
    counts = word.groupBy("bucket").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)])
    telling = F.lit(False)
    for i, s in enumerate(shares):
        expected = F.col("n") * s
        telling |= (F.col(f"n{i}") - expected >= LEAST_SURPRISE * F.sqrt(expected * (1 - s))) & (F.col(f"n{i}") >= LEAST_LIFT * expected)
    weights = [
        F.round(SCALE * (F.log((F.col(f"n{i}") + SMOOTHING * s) / (F.col("n") + SMOOTHING)) - math.log(s))).cast("long").alias(f"w{i}") for i, s in enumerate(shares)
    ]
    return staged(counts.filter(telling).select("bucket", *weights), "word-weights"), [round(SCALE * math.log(s)) for s in shares]


def _scores(docs: DataFrame, model: DataFrame, priors: list[int], id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text_hash, n_copies, n_tokens, s0, s1, ...): log scores, one row per different (id, text).

    Words meet the model, whose size is bounded, in a broadcast join next to the scan; those it lacks
    go at once, and the rest is summed by (id, text hash) before the shuffle.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k = range(len(priors))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("n_tokens"), text.alias("text"), *more)
    words = slim.select("id", "text_hash", "n_tokens", *more, F.posexplode_outer(_features(F.col("text"))).alias("at", "word"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    scored = words.withColumn("bucket", _bucket(F.col("word"))).join(F.broadcast(model), "bucket", "left").filter(first | F.col("w0").isNotNull())
    sums = scored.groupBy("id", "text_hash").agg(
        F.count_if(first).alias("n_copies"), F.max("n_tokens").alias("n_tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"_w{i}") for i in k],
        *[F.min(c).alias(c) for c in more],
    )
    # Sums hold all copies of a row; a copy's share is exact.
    return sums.select("id", "text_hash", "n_copies", "n_tokens", *more, *[((F.expr(f"_w{i} div n_copies") + priors[i]) / SCALE).alias(f"s{i}") for i in k])


def _margin(i: int, k: int) -> Column:
    """Log score of a domain over the best other one; a single domain has no other."""
    others = [F.col(f"s{j}") for j in range(k) if j != i]
    return F.col(f"s{i}") - (F.greatest(*others) if len(others) > 1 else others[0] if others else F.lit(0.0))


def calibrated(scores: DataFrame, domains: list[str], domain_col: str = "domain", rounds: int = 12) -> list[tuple[float, float]]:
    """Slope and offset per domain that turn margins into probabilities, fitted on texts not counted.

    Logistic regression with one input, by Newton steps; each is one aggregate. A weak pull towards
    slope 1 and offset 0 decides where the texts don't.
    """
    k = len(domains)
    fits = [(1.0, 0.0)] * k
    for _ in range(rounds):
        sums = []
        for i, (a, b) in enumerate(fits):
            x = F.greatest(F.least(_margin(i, k), F.lit(50.0)), F.lit(-50.0))
            p = 1 / (1 + F.exp(-(a * x + b)))
            off, w = p - (F.col(domain_col) == domains[i]).cast("double"), p * (1 - p)
            sums += [F.sum(off * x), F.sum(off), F.sum(w * x * x), F.sum(w * x), F.sum(w)]
        row = [float(v or 0) for v in scores.agg(*[c.alias(f"c{n}") for n, c in enumerate(sums)]).first()]
        new = []
        for i, (a, b) in enumerate(fits):
            ga, gb, haa, hab, hbb = row[5 * i:5 * i + 5]
            ga, gb, haa, hbb = ga + (a - 1), gb + b, haa + 1, hbb + 1
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            length = max(1.0, abs(da), abs(db) / 4)
            new.append((round(max(0.02, a - da / length), 6), round(b - db / length, 6)))
        if new == fits:
            break
        fits = new
    return fits


def posteriors(scores: DataFrame, fits: list[tuple[float, float]]) -> DataFrame:
    """Scores as posteriors p0, p1, ... that sum to 1."""
    k = len(fits)
    odds = {f"_e{i}": 1 / (1 + F.exp(-F.greatest(F.least(a * _margin(i, k) + b, F.lit(30.0)), F.lit(-30.0)))) for i, (a, b) in enumerate(fits)}
    whole = sum((F.col(e) for e in odds), F.lit(0.0))
    keep = [c for c in scores.columns if c not in {f"s{i}" for i in range(k)}]
    return scores.withColumns(odds).select(*keep, *[F.round(F.col(f"_e{i}") / whole, 9).alias(f"p{i}") for i in range(k)])


def _expected(rows: DataFrame, k: int) -> list[int]:
    """Expected tokens of every domain at the present rates, in 1/1000 tokens."""
    tokens = F.col("n_tokens") * F.col("n_copies")
    sums = rows.agg(*[F.sum(F.round(1000 * tokens * F.col("rate") * F.col(f"p{i}")).cast("decimal(38,0)")).alias(f"s{i}") for i in range(k)]).first()
    return [int(s or 0) for s in sums]


def fit_rates(rows: DataFrame, weights: list[float], budget: float | None = None, top: float | None = None, steps: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, dict]:
    """Add ``rate`` to a table of posteriors; also what was asked for and reached.

    ``weights`` are the wanted shares of the domains, ``budget`` the wanted tokens in all (by default as
    many as there are), ``top`` an upper bound of rates. A domain without expected tokens can't be
    filled and is left out.
    """
    k = len(weights)
    rows = rows.withColumn("rate", F.lit(1.0))
    start = _expected(rows, k)
    total = sum(start) if budget is None else 1000 * budget
    share = sum(w for w, s in zip(weights, start) if s) or 1.0
    target = [total * w / share if s else 0.0 for w, s in zip(weights, start)]
    now = start
    for step in range(steps):
        off = [(s - t) / c if c else 0.0 for s, t, c in zip(now, target, start)]
        if max(abs(s - t) for s, t in zip(now, target)) <= tolerance * total:
            break
        moved = F.col("rate") - sum((F.col(f"p{i}") * F.lit(off[i]) for i in range(k)), F.lit(0.0))
        rate = F.greatest(moved, F.lit(0.0))
        rows = rows.withColumn("rate", F.least(rate, F.lit(top)) if top is not None else rate)
        if step % STEPS_PER_WRITE == STEPS_PER_WRITE - 1:
            rows = staged(rows, "rates")
        now = _expected(rows, k)
    return staged(rows, "rates"), {"target": [t / 1000 for t in target], "reached": [s / 1000 for s in now], "available": [s / 1000 for s in start]}


#: Labelled documents the classifier is fitted on, about at most; an even share by hash of the id.
LABELLED = 20_000


def with_domain(docs: DataFrame, labels: DataFrame, domains: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Different labelled texts (text, domain, half): half 0 is counted, half 1 calibrates.

    ``domains`` are conditions on the label columns, the first that holds decides. The sampled ids are
    broadcast: they are different and about LABELLED at most, so only sampled texts are shuffled.
    """
    domain = F.coalesce(*[F.when(c, F.lit(d)) for d, c in domains.items()])
    known = labels.select(F.col("doc_id").alias("_labelled"), domain.alias("domain")).filter("domain IS NOT NULL AND _labelled IS NOT NULL")
    known = known.groupBy("_labelled").agg(F.min("domain").alias("domain"))
    share = int(min(1.0, LABELLED / max(1, known.count())) * (1 << 20))
    known = known.filter(F.pmod(F.xxhash64("_labelled"), F.lit(1 << 20)) < share)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("text")).join(F.broadcast(known), F.col("_id") == F.col("_labelled"))
    once = joined.groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.min("domain").alias("domain"))
    return once.withColumn("half", F.pmod("hash", F.lit(2)))


def by_label() -> dict[str, Column]:
    """Domains of the labels table."""
    return {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1, "plain": F.col("quality") == 0}


def soft_mixture(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget_share: float | None = None, top: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", domains: dict[str, Column] | None = None,
) -> tuple[DataFrame, dict]:
    """Rates of all documents: (id, text_hash, n_copies, n_tokens, p_<domain>..., rate, n_drawn), and the fit.

    ``weights`` are shares of expected tokens. ``n_drawn`` is the rate rounded up or down by a hash of
    the id, so that it is the rate on average and the same in every run. Labels without a document
    and documents without a label are no errors; without any label all posteriors equal the priors.
    A null text has no words, one token and the prior. Rows equal in id and text share one row.
    """
    names = list(weights)
    known = staged(with_domain(docs, labels, domains or by_label(), id_col, text_col), "labelled")
    model, priors = classifier(known.filter("half = 0"), names)
    fits = calibrated(staged(_scores(known.filter("half = 1"), model, priors, "hash", "text", "domain"), "labelled-scores"), names)
    rows = staged(posteriors(_scores(docs, model, priors, id_col, text_col), fits), "posteriors")
    tokens = rows.agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).first()[0] or 0
    rated, fit = fit_rates(rows, list(weights.values()), None if budget_share is None else budget_share * tokens, top)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(F.col("rate") + chance).cast("int")
    named = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)]
    return rated.select("id", "text_hash", "n_copies", "n_tokens", *named, "rate", drawn.alias("n_drawn")), fit


def drawn(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as often as drawn, with all their columns."""
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    id_, hash_, n, copy = (free_name(docs.columns, c) for c in ("id", "hash", "drawn", "copy"))
    wanted = rates.select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.col("n_drawn").alias(n)).filter(f"{n} > 0")
    joined = docs.join(wanted, same([F.col(f"`{id_col}`"), text], [F.col(id_), F.col(hash_)]))
    copies = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
