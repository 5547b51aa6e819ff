"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good (1), bad (0) or abstain
(null); those that look for one fault vote bad or abstain. One aggregation
over all documents counts the vote patterns, of which there are at most
3^labellers; expectation-maximisation over these counts estimates how often
every labeller votes each way on either class, hence its accuracy, and the
share of good documents, without any gold label. The posterior of a pattern is the
soft label that trains a hashed linear scorer (logistic regression over
hashed word endings and hashed measure buckets), which then scores every
whole text.

The scorer is trained on at most about TRAIN_ROWS documents; counts and
accuracies cover all documents.

Defined results: a null or blank text has no words; its labellers vote on
that like on any other. An empty table gives no rows. Extra columns of any
name pass through, but for the operator's own output columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import SPACE_CLASS, WORD

TRAIN_ROWS = 20_000
WORD_BUCKETS, MEASURE_BUCKETS = 1 << 16, 1 << 10
EM_ROUNDS = 100
KEEP = 0.4                   # scores below this are rejected; leans towards keeping


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the struct ``_m`` of measures and the array ``_w`` of words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.char_length(text)
    without = lambda pattern: length - F.char_length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    base = docs.drop("_w", "_m").withColumn("_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    n = F.size("_w")
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    letters, capitals = without(r"\p{L}+"), without(r"\p{Lu}+")
    return base.withColumn("_m", F.struct(
        n.alias("words"),
        share(F.char_length(F.array_join("_w", "")), n).alias("word_length"),
        share(F.size(F.array_distinct("_w")), n).alias("distinct"),
        share(without(r"[#*$%&|<>!]+"), n).alias("symbols"),
        share(letters, length).alias("letters"),
        share(capitals, letters).alias("capitals"),
        F.transform(F.array(lines), lambda x: share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))[0].alias("same_lines"),
    ))


def labellers() -> dict[str, Column]:
    """Votes over the measures; each abstains in between."""
    m = lambda name: F.col(f"_m.{name}")
    fault = lambda bad: F.when(bad, 0)
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    some = m("words") >= 20
    return {
        "symbols": fault(m("symbols") > 0.1),
        "letters": fault(m("letters") < 0.7),
        "capitals": fault(m("capitals") > 0.5),
        "distinct": fault(some & (m("distinct") < 0.15)),
        "same_lines": fault(m("same_lines") > 0.3),
        "word_length": vote(m("word_length").between(4.3, 5.8), ~m("word_length").between(3.2, 6.8)),
        "prose": vote((m("words") >= 50) & m("letters").between(0.76, 0.86) & (m("distinct") > 0.25), m("words") < 5),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, vote shares (class x labeller x bad, abstain, good), share of good.

    ``patterns``: 1, 0 or -1 for abstain; labellers are independent given the class. Starts from bad votes being
    likelier on bad documents, which tells the classes apart. One pseudo-vote each way keeps shares inside (0, 1).
    """
    cast = np.stack([patterns == 0, patterns == -1, patterns == 1]).astype(float)       # vote x pattern x labeller
    shares = np.repeat(np.array([[0.4, 0.4, 0.2], [0.05, 0.4, 0.55]])[:, None, :], patterns.shape[1], axis=1)
    prior, posterior = 0.8, np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.einsum("vpl,clv->cp", cast, np.log(shares)) + np.log([1 - prior, prior])[:, None]
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        weight = np.stack([counts * (1 - now), counts * now])
        shares = np.einsum("cp,vpl->clv", weight, cast) + 1
        shares /= shares.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        done = np.abs(now - posterior).max(initial=0) < 1e-9
        posterior = now
        if done:
            break
    return posterior, shares, float(prior)


def accuracies(shares: np.ndarray, prior: float) -> np.ndarray:
    """Per labeller, how often its votes (abstentions aside) are right."""
    right = (1 - prior) * shares[0, :, 0] + prior * shares[1, :, 2]
    wrong = (1 - prior) * shares[0, :, 2] + prior * shares[1, :, 0]
    return right / (right + wrong)


def _features(measured: DataFrame) -> DataFrame:
    """Hashed word endings (scaled to length one) and hashed buckets of the measures."""
    bucket = lambda name, step: F.concat(F.lit(f"{name}="), F.floor(F.col(f"_m.{name}") / step).cast("string"))
    shaped = measured.withColumns({
        "_e": F.transform("_w", lambda w: F.right(w, F.lit(3))),
        "_b": F.array(F.concat(F.lit("words="), F.floor(F.log2(F.col("_m.words") + 1)).cast("string")), bucket("word_length", 0.5),
                      bucket("distinct", 0.05), bucket("symbols", 0.05), bucket("letters", 0.02), bucket("capitals", 0.1),
                      bucket("same_lines", 0.1)),
    }).drop("_w")
    hashed = HashingTF(inputCol="_e", outputCol="_h", numFeatures=WORD_BUCKETS).transform(shaped)
    hashed = HashingTF(inputCol="_b", outputCol="_g", numFeatures=MEASURE_BUCKETS, binary=True).transform(hashed)
    scaled = Normalizer(inputCol="_h", outputCol="_u").transform(hashed)
    return VectorAssembler(inputCols=["_u", "_g"], outputCol="_x").transform(scaled).drop("_e", "_b", "_h", "_g", "_u")


def _pattern(votes: dict[str, Column]) -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in votes.values():
        out = out * 3 + F.coalesce(v + 1, F.lit(0))
    return out.cast("int")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, float], LogisticRegressionModel | None, dict]:
    """Posterior per vote pattern, the scorer (None without rows), and the estimated accuracies by labeller."""
    votes = labellers()
    measured = _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t").withColumn("_v", _pattern(votes))
    found = sorted((r["_v"], r["count"]) for r in measured.groupBy("_v").count().collect())      # at most 3^labellers rows
    if not found:
        return {}, None, {}
    codes, counts = np.array(found).T
    k = len(votes)
    patterns = (codes[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3 - 1
    posterior, shares, prior = estimate(patterns, counts.astype(float))
    table = {int(c): float(p) for c, p in zip(codes, posterior)}

    fraction = min(1.0, TRAIN_ROWS / int(counts.sum()))
    lucky = F.shiftrightunsigned(F.xxhash64(F.lit(29), "id"), 33).cast("double") / float(1 << 31)
    sample = _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(lucky <= fraction), "t")
    soft = _features(sample.withColumn("p", _lookup(_pattern(votes), table))).select("_x", "p")
    # each document once per class, weighted by the posterior
    both = soft.select("_x", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
                                               F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y"))
    train = both.select("_x", "y.label", "y.weight").filter("weight > 0").persist()
    try:
        scorer = None if train.isEmpty() else LogisticRegression(
            featuresCol="_x", labelCol="label", weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(train)
    finally:
        train.unpersist()
    return table, scorer, dict(zip(votes, accuracies(shares, prior).tolist()))


def _lookup(code: Column, table: dict[int, float]) -> Column:
    pairs = [F.lit(x) for c, p in table.items() for x in (c, p)]
    return F.element_at(F.create_map(*pairs), code)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_votes``, ``posterior`` (of the label model), ``score`` (of the scorer, 0 to 1) and ``kept``."""
    docs = docs.drop("n_votes", "posterior", "score", "kept")
    table, scorer, _ = fit(docs, id_col, text_col)
    if scorer is None:
        return docs.withColumns({"n_votes": F.lit(0).cast("long"), "posterior": F.lit(0.0), "score": F.lit(0.0), "kept": F.lit(False)})
    votes = labellers()
    voted = sum((v.isNotNull().cast("long") for v in votes.values()), F.lit(0).cast("long"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"))         # no name of theirs can clash
    measured = _measured(rows, "t").withColumns({"n_votes": voted, "posterior": _lookup(_pattern(votes), table)})
    scorer = scorer.setProbabilityCol("_q").setRawPredictionCol("").setPredictionCol("")
    scored = scorer.transform(_features(measured))
    return (scored.withColumn("score", vector_to_array("_q")[1]).withColumn("kept", F.col("score") >= KEEP)
            .select("row.*", "n_votes", "posterior", "score", "kept"))
