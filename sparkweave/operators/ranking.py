"""Second-stage scores, diversification and learning to rank, over one candidate list for each query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V
from sparkweave.operators import maintenance


def of_list() -> WindowSpec:
    """The candidates of one query."""
    return Window.partitionBy("query_id")


#: Weights of the two-stage blend by kind of query (vector, species, source, diversity).
WEIGHTS = {"default": (0.70, 0.05, 0.15, 0.0), "specific": (0.80, 0.05, 0.10, 0.05), "general": (0.65, 0.05, 0.15, 0.15), "ambiguous": (0.70, 0.05, 0.15, 0.10)}
#: Default weights of the linear model, by feature, in order.
FEATURES = {"vector_similarity": 0.30, "cosine_similarity": 0.20, "l2_distance": -0.10, "species_frequency": 0.10, "species_popularity": 0.05, "image_quality": 0.10, "source_score": 0.05, "temporal_score": 0.05, "diversity_score": 0.05, "click_through_rate": 0.05, "conversion_rate": 0.05}
#: Fixed value: queries with less spread are taken for field pictures where there is no hit to tell.
SPREAD_OF_FIELD = 0.2
#: What the features are at query time where nothing is known.
DEFAULTS = {"image_quality": 0.8, "temporal_score": 0.5, "diversity_score": 0.5, "click_through_rate": 0.1, "conversion_rate": 0.1}


def min_max(score: Column, constant: Column | float) -> Column:
    lo, hi = F.min(score).over(of_list()), F.max(score).over(of_list())
    return F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(constant if isinstance(constant, Column) else F.lit(float(constant)))


def tempered_softmax(distance: Column) -> Column:
    """exp(-d / T) over the list; T is a quarter of the interquartile range."""
    iqr = F.percentile(distance, 0.75).over(of_list()) - F.percentile(distance, 0.25).over(of_list())
    t = F.greatest(F.greatest(iqr, F.lit(1e-6)) * 0.25, F.lit(1e-6))
    e = F.exp(-(distance - F.min(distance).over(of_list())) / t)
    return e / (F.sum(e).over(of_list()) + 1e-9)


def idf_prior(count: Column) -> Column:
    """log1p(max / count) over the list's species, min-max, to the power 0.3; 0.5 if constant."""
    raw = F.log1p(F.max(count).over(of_list()) / count)
    return F.pow(min_max(raw, 0.5), F.lit(0.3))


def source_score(source: Column, preferred: Column, quality: Column | None = None) -> Column:
    s = F.when(source == preferred, 1.0).otherwise(0.7)
    return s if quality is None else F.least(F.lit(1.0), s * (0.9 + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))))


def source_vote(hits: DataFrame) -> DataFrame:
    """(query_id, preferred): the majority of the first five sources; a tie is field."""
    lab = F.count_if(F.col("source") == "lab")
    return hits.filter("rank <= 5").groupBy("query_id").agg(F.when(lab * 2 > F.count("*"), "lab").otherwise("field").alias("preferred"))


def preferred_sources(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, preferred) of every query (query_id, v): the vote of its hits, or without hits what its spread tells."""
    spread = F.when(F.round(V.deviation(F.col("v")), 9) < SPREAD_OF_FIELD, "field").otherwise("lab")
    return queries.join(source_vote(hits), "query_id", "left").select("query_id", F.coalesce("preferred", spread).alias("preferred"))


def blend(vector: Column, species: Column, source: Column, diversity: Column, kind: str = "default") -> Column:
    a, b, c, d = WEIGHTS[kind]
    return (a * vector + b * species + c * source + d * diversity) / (a + b + c + d)


def query_kind(deviation: Column, greatest: Column) -> Column:
    return F.when((deviation > 0.15) & (greatest > 2), "specific").when(deviation < 0.08, "general").otherwise("ambiguous")


def _mmr(k: int, weight: float, free: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy order of one list, by bounded candidates (the list's length)."""
    pdf = pdf.sort_values(["relevance", "file_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
    rel, near, left, order = pdf["relevance"].to_numpy(float), np.full(len(pdf), -np.inf), list(range(len(pdf))), []
    while left and len(order) < k:
        if len(order) < max(1, free):
            i = left[0]
        else:
            s = np.round(weight * rel[left] - (1 - weight) * near[left], 6)
            i = left[int(np.argmax(s))]
        order.append(i)
        left.remove(i)
        near = np.maximum(near, x @ x[i])
    return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].to_numpy(), "position": np.arange(1, len(order) + 1), "file_id": pdf["file_id"].iloc[order].to_numpy(), "relevance": rel[order]})


def mmr(candidates: DataFrame, k: int = 10, weight: float = 0.7, free: int = 1) -> DataFrame:
    """Maximal marginal relevance: (query_id, position, file_id, relevance). A list is bounded by its retrieval limit."""
    rows = candidates.select("query_id", "file_id", "relevance", "v")
    return rows.groupBy("query_id").applyInPandas(lambda pdf: _mmr(k, weight, free, pdf), "query_id bigint, position bigint, file_id bigint, relevance double")


def _feature_diversity(k: int, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["relevance", "file_id"], ascending=[False, True]).reset_index(drop=True)
    x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
    rel, left, order = pdf["relevance"].to_numpy(float), list(range(len(pdf))), []
    while left and len(order) < k:

        def value(i: int) -> float:
            if not order:
                return 0.7 * rel[i] + 0.3
            same = sum(pdf["species"][j] == pdf["species"][i] for j in order)
            other = all(pdf["source"][j] != pdf["source"][i] for j in order)
            div = 0.4 * 0.5**same + 0.2 * (1.0 if other else 0.5) + 0.4 * (1 - max(float(x[i] @ x[j]) for j in order))
            return 0.7 * rel[i] + 0.3 * div

        i = max(left, key=lambda n: (round(value(n), 6), -n))
        order.append(i)
        left.remove(i)
    return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].to_numpy(), "position": np.arange(1, len(order) + 1), "file_id": pdf["file_id"].iloc[order].to_numpy()})


def feature_diversity(candidates: DataFrame, k: int = 10) -> DataFrame:
    return candidates.groupBy("query_id").applyInPandas(lambda pdf: _feature_diversity(k, pdf), "query_id bigint, position bigint, file_id bigint")


def best_of_clusters(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The best of each cluster first, then by score. candidates: (query_id, file_id, relevance, cluster)."""
    turn = F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy(F.desc("relevance"), "file_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("turn") > 1, F.desc("relevance"), "file_id")
    return candidates.withColumn("turn", turn).withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= k).select("query_id", "position", "file_id", "cluster")


def linear_score(weights: dict[str, float] = FEATURES) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * F.col(name)
    return out


def _gradient(names: list[str], weights: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x, y = pdf[names].to_numpy(float), pdf["label"].to_numpy(float)
        g = x * (x @ weights - y)[:, None] * 2
        out = pd.DataFrame(g, columns=names)
        out["query_id"] = pdf["query_id"].to_numpy()
        out = out.groupby("query_id", as_index=False).sum()
        out["n"] = pdf.groupby("query_id").size().to_numpy()
        yield out


def train_linear(rows: DataFrame, iterations: int = 10, rate: float = 0.01, start: dict[str, float] = FEATURES) -> dict[str, float]:
    """Full-batch gradient descent on the mean over queries of their squared error. rows: (query_id, label, features)."""
    names = list(start)
    w = np.array([start[n] for n in names])
    kind = "query_id bigint, n bigint, " + ", ".join(f"{n} double" for n in names)
    for _ in range(iterations):
        now = w.copy()
        sums = rows.mapInPandas(lambda b, now=now: (x[["query_id", "n", *names]] for x in _gradient(names, now, b)), kind)
        per = sums.groupBy("query_id").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
        g = per.agg(*[F.avg(F.col(n) / F.col("n")).alias(n) for n in names]).first()
        w = w - rate * np.array([g[n] or 0.0 for n in names])
    return dict(zip(names, w.tolist(), strict=True))


def pairwise_loss(rows: DataFrame) -> DataFrame:
    """(query_id, pairs, loss): cross-entropy of score differences over pairs with different labels. A list is bounded."""
    a = rows.select("query_id", F.col("file_id").alias("i"), F.col("score").alias("si"), F.col("label").alias("yi"))
    b = rows.select("query_id", F.col("file_id").alias("j"), F.col("score").alias("sj"), F.col("label").alias("yj"))
    p = 1 / (1 + F.exp(-(F.col("si") - F.col("sj"))))
    cost = F.when(F.col("yi") > F.col("yj"), -F.log(p + 1e-8)).when(F.col("yi") < F.col("yj"), -F.log(1 - p + 1e-8)).otherwise(0.0)
    return a.join(b, "query_id").filter("i < j").groupBy("query_id").agg(F.count("*").alias("pairs"), F.round(F.avg(cost), 6).alias("loss"))


def evaluate(rows: DataFrame) -> DataFrame:
    """(query_id, n, mse, mae, ndcg, spearman) of (query_id, file_id, label, score). spearman is NaN, as SQL's corr, where
    all scores or all labels of a list are equal; F.corr would divide by zero there."""
    err = F.col("score") - F.col("label")
    by_score, by_label = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id"), Window.partitionBy("query_id").orderBy(F.desc("label"), "file_id")
    gain = F.col("label") / F.log2(F.row_number().over(by_score) + 1)
    ideal = F.col("label") / F.log2(F.row_number().over(by_label) + 1)

    def mean_rank(name: str) -> Column:
        return F.rank().over(Window.partitionBy("query_id").orderBy(name)) + (F.count("*").over(Window.partitionBy("query_id", name)) - 1) / 2

    spearman = F.try_divide(F.covar_pop("rs", "rl"), F.stddev_pop("rs") * F.stddev_pop("rl"))
    x = rows.select("query_id", "label", err.alias("e"), gain.alias("g"), ideal.alias("i"), mean_rank("score").alias("rs"), mean_rank("label").alias("rl"))
    return x.groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("e") * F.col("e")), 6).alias("mse"), F.round(F.avg(F.abs("e")), 6).alias("mae"),
        F.round(F.coalesce(F.try_divide(F.sum("g"), F.sum("i")), F.lit(0.0)), 6).alias("ndcg"), (F.round(F.coalesce(spearman, F.lit(float("nan"))), 6) + 0.0).alias("spearman"),
    )


def interpolate(candidates: DataFrame, k: int = 10, query: str = "query_id", key: str = "file_id") -> DataFrame:
    """(query, key, final): what a re-ranked sample says about the rest of each list.

    candidates: (query, key, score, reranked), reranked null outside the sample. The others take the mean of the k
    samples nearest by score, weighted by nearness; ties go to the lesser key. Without samples the score stays.
    Lists are short (top-k of a search), so a list's samples are an array of its row.
    """
    samples = candidates.filter("reranked IS NOT NULL").groupBy(query).agg(F.collect_list(F.struct("score", key, "reranked")).alias("samples"))
    near = F.slice(F.array_sort(F.transform("samples", lambda s: F.struct(F.abs(F.col("score") - s["score"]).alias("d"), s[key].alias("k"), s["reranked"].alias("r")))), 1, k)
    weight = F.aggregate(near, F.lit(0.0), lambda a, s: a + 1 / (s["d"] + 1e-8))
    mean = F.aggregate(near, F.lit(0.0), lambda a, s: a + s["r"] / (s["d"] + 1e-8)) / weight
    x = candidates.join(samples, query, "left")
    return x.select(query, key, F.coalesce("reranked", F.when(F.size("samples") > 0, mean), "score").alias("final"))


def weights_by_kind(kinds: DataFrame) -> DataFrame:
    """kinds (query_id, kind) with the blend's weights of each kind: one row for each kind is joined."""
    table = kinds.sparkSession.createDataFrame([(k, *w) for k, w in WEIGHTS.items()], "kind string, vector double, prior double, origin double, variety double")
    return kinds.join(F.broadcast(table), "kind")


def adaptive_blend(vector: Column, species: Column, source: Column, diversity: Column) -> Column:
    """blend() by the columns of weights_by_kind."""
    w = [F.col(c) for c in ("vector", "prior", "origin", "variety")]
    return (w[0] * vector + w[1] * species + w[2] * source + w[3] * diversity) / (w[0] + w[1] + w[2] + w[3])


def by_position(score: Column, order: WindowSpec) -> tuple[Column, Column]:
    """(weight, product): 1 / place in the list, and the score times that."""
    weight = 1.0 / F.row_number().over(order)
    return weight, weight * score


#: Lists longer than this are re-ranked by a sample.
SAMPLED_BEYOND = 500


def sample_lists(candidates: DataFrame, least: int = 100, share: float = 0.3, seed: int = 42) -> DataFrame:
    """candidates (query_id, file_id, score) with sampled: without replacement, max(least, share of the list) of each list,
    weighted by how far a score is below the list's greatest. The draw is a hash's, so reruns agree."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "query_id", "file_id", F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("double") + 1) / 281474976710657.0
    weight = F.max("score").over(of_list()) - F.col("score") + 1e-8
    x = candidates.withColumn("draw", F.round(-F.log(u) / weight, 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("draw", "file_id"))
    size = F.greatest(F.lit(least), F.floor(F.count("*").over(of_list()) * share))
    return x.withColumn("sampled", place <= size).drop("draw")


def sampled_rerank(candidates: DataFrame, reranked: Column, least: int = 100, share: float = 0.3) -> DataFrame:
    """(query_id, file_id, final, place): the sample gets the score ``reranked``, the others what their neighbours say."""
    sampled = sample_lists(candidates, least, share).withColumn("reranked", F.when(F.col("sampled"), reranked))
    final = interpolate(sampled).withColumn("final", F.round("final", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "file_id")).cast("long")
    return final.withColumn("place", place)


def synthetic_label(vector: Column, cosine: Column, distance: Column, frequency: Column, quality: Column, source: Column) -> Column:
    """A label from 0 to 5 where no feedback is known."""
    x = 0.3 * vector + 0.2 * cosine + 0.2 * (1 - distance) + 0.1 * frequency + 0.1 * quality + 0.1 * source
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), 5 * x))


def synthetic_features(rows: DataFrame, key: str, source: Column, seed: int = 42) -> DataFrame:
    """rows with every feature of the model: uniform in [0, 1) by a hash of key, name and seed, but for the source's score."""
    u = lambda n: F.conv(F.substring(maintenance.hash_order(F.col(key), F.lit(n), F.lit(seed)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return rows.withColumns({n: F.when(source == "lab", 1.0).otherwise(0.5) if n == "source_score" else u(n) for n in FEATURES})


def search_by_model(candidates: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """(query_id, place, file_id, score): the candidates' features by a model's weights, best first."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")).cast("long")
    scored = candidates.select("query_id", "file_id", F.round(linear_score(weights), 5).alias("score"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def run_training(rows: DataFrame, epochs: int = 3, start: dict[str, float] = FEATURES) -> tuple[dict[str, float], DataFrame]:
    """(weights, evaluation of the test queries): queries are split by hash, the weights that do best on the validation
    queries are kept. rows: (query_id, file_id, label, features). A part without rows is an error, before any training."""
    x = rows.join(maintenance.stratified_split(rows.select("query_id").distinct().withColumn("all", F.lit(0)), "query_id", "all"), "query_id")
    part = {s: x.filter(F.col("split") == s) for s in ("train", "val", "test")}
    for name, p in part.items():
        if p.isEmpty():
            raise ValueError(f"no queries to {name}")
    weights, _ = train_validated(part["train"], part["val"], epochs, start=start)
    return weights, evaluate(part["test"].select("query_id", "file_id", "label", F.round(linear_score(weights), 5).alias("score")))


def _pairs(rows: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of one list with different labels, the greater first, with the differences of their features."""
    a = rows.select("query_id", F.col("file_id").alias("i"), F.col("label").alias("yi"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = rows.select("query_id", F.col("file_id").alias("j"), F.col("label").alias("yj"), *[F.col(n).alias(f"b_{n}") for n in names])
    return a.join(b, "query_id").filter("yi > yj").select("query_id", "i", "j", *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names])


def pairwise_gradient(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature..., pairs): the mean gradient of the pairwise cross-entropy, one row. Lists are bounded by retrieval."""
    names = list(weights)
    miss = 1 / (1 + F.exp(linear_score(weights)))
    return _pairs(rows, names).withColumn("miss", miss).agg(*[F.coalesce(F.avg(-F.col("miss") * F.col(n)), F.lit(0.0)).alias(n) for n in names], F.count("*").alias("pairs"))


def train_pairwise(rows: DataFrame, iterations: int = 10, rate: float = 0.01, start: dict[str, float] | None = None) -> dict[str, float]:
    """RankNet with a linear score: gradient descent over all pairs. rows: (query_id, file_id, label, features)."""
    w = dict(start or dict.fromkeys(FEATURES, 0.0))
    for _ in range(iterations):
        g = pairwise_gradient(rows, w).first()
        w = {n: x - rate * g[n] for n, x in w.items()}
    return w


def squared_error(weights: dict[str, float]) -> Column:
    return F.avg(F.pow(linear_score(weights) - F.col("label"), F.lit(2.0)))


def train_validated(train: DataFrame, valid: DataFrame, epochs: int = 5, rate: float = 0.01, start: dict[str, float] = FEATURES) -> tuple[dict[str, float], list[tuple[int, float, float]]]:
    """(the weights that did best on valid, (epoch, training error, validation error) of each epoch)."""
    w, best, curve = dict(start), (float("inf"), dict(start)), []
    for epoch in range(1, epochs + 1):
        w = train_linear(train, 1, rate, w)
        mine, theirs = (x.agg(squared_error(w).alias("e")).first().e for x in (train, valid))
        curve.append((epoch, mine, theirs))
        if theirs is not None and theirs < best[0]:
            best = (theirs, dict(w))
    return best[1], curve


#: Kinds of model; those that are no linear one of their own fall back to it.
ALGORITHMS = {"linear": "linear", "pairwise": "pairwise", "lambdamart": "linear", "listwise": "linear"}


def train(rows: DataFrame, algorithm: str = "linear", **options: object) -> tuple[str, dict[str, float]]:
    """(kind that was trained, weights). An unknown kind is an error."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    kind = ALGORITHMS[algorithm]
    return kind, (train_pairwise if kind == "pairwise" else train_linear)(rows, **options)


def update_online(weights: dict[str, float], batch: DataFrame, rate: float = 0.01) -> dict[str, float]:
    """The weights after one step on the feedback of a batch (in foreachBatch of a stream)."""
    return train_linear(batch, 1, rate, weights)


def diversify(candidates: DataFrame, algorithm: str, k: int = 10) -> DataFrame:
    """(query_id, position, file_id) by mmr, clusters, features or plain score; dpp and hybrid are plain score too."""
    if algorithm == "mmr":
        return mmr(candidates, k).select("query_id", "position", "file_id")
    if algorithm == "clusters":
        return best_of_clusters(candidates, k).select("query_id", "position", "file_id")
    if algorithm == "features":
        return feature_diversity(candidates, k)
    if algorithm not in ("none", "dpp", "hybrid"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "file_id")).cast("long")
    return candidates.withColumn("position", place).filter(F.col("position") <= k).select("query_id", "position", "file_id")
