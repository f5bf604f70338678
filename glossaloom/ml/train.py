"""One classifier for each tag over TF-IDF features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import any_in
from ..operators.sample import split
from ..operators.validate import score
from .forest import RandomForest

#: Words that say nothing; fixed values, those of Spark's list for English that tokens can be.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now cannot could ought would"
).split()

LEAVES, SPLITS, TREES = (1, 2, 4, 8), (2, 4, 8, 16), range(10, 101)


def fit_features(rows: DataFrame, text: str = "chunk") -> PipelineModel:
    """Words of two or more letters, without stop words, as smoothed and normalised TF-IDF."""
    cut = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\w\w+", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=STOP),
    ]).fit(rows)
    kept = cut.transform(rows)
    size = kept.select(F.explode("_kept").alias("w")).distinct().count()
    counter = CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=max(size, 1)).fit(kept)
    counted = PipelineModel([*cut.stages, counter])
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted.transform(rows)).idf
    # weights are ln((n+1)/(df+1)) + 1
    weigh = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense(idf.toArray() + 1.0))
    return PipelineModel([*counted.stages, weigh, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)])


def naive_bayes(tag: str):
    return Pipeline(stages=[NaiveBayes(featuresCol="features", labelCol=tag, predictionCol="prediction", modelType="multinomial", smoothing=1.0)])


def random_forest(tag: str, trees: int = 25, min_leaf: int = 2, depth: int = 20, seed: int = 42):
    """A forest of sparse rows; scaled features would give the same splits. There is no least size for a split; the least leaf size is what bounds it."""
    if trees not in TREES or min_leaf not in LEAVES:
        raise ValueError("10 to 100 trees; leaves of 1, 2, 4 or 8")
    return Pipeline(stages=[RandomForest(tag, trees, min_leaf, depth, seed)])


def train(rows: DataFrame, tags: Sequence[str], algorithm: str = "nb", *, rate: int = 100, text: str = "chunk", key: Sequence[str] = ("chunk",), **options) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Models by tag, and (class, name, accuracy, precision, recall, f1) on the fifth that was held out.

    Features are fitted once on the training part and shared by all tags. The rows are computed once, and so are the metrics.
    """
    if algorithm not in ("nb", "rf"):
        raise ValueError("nb or rf")
    rows = rows.select(*dict.fromkeys([text, *key, *tags])).cache()  # else each pass makes the training rows again
    first, held = split(rows, 80, key=key)
    shared = fit_features(first, text)
    first, held = (shared.transform(x).select("features", F.xxhash64(*key).alias("_key"), *tags).cache() for x in (first, held))
    models, scores, schema = {}, [], None
    for tag in tags:
        model = (naive_bayes(tag) if algorithm == "nb" else random_forest(tag, **options)).fit(first)
        models[tag] = PipelineModel([*shared.stages, *model.stages])
        found = score(model.transform(held).select(F.col(tag).alias("truth"), F.col("prediction").cast("int").alias("predicted")))
        found = found.select(F.lit(tag).alias("class"), F.lit(f"{algorithm.upper()}_{rate}-{tag}").alias("name"), "*")
        scores, schema = [*scores, *found.collect()], found.schema  # one row
    for x in (first, held, rows):
        x.unpersist()
    return models, rows.sparkSession.createDataFrame(scores, schema)


def classify(extracts: DataFrame, models: Mapping[str, PipelineModel], keywords: Mapping[str, Sequence[str]], *, chunks: str = "chunks") -> DataFrame:
    """``extracts`` with each tag: 1 if a chunk with one of its keywords is predicted 1, else 0.

    Chunks go through all models in one pass and meet their row once; rows may repeat. The row goes with its first chunk alone.
    """
    row = F.struct(*extracts.columns)
    keyed = extracts.select(F.monotonically_increasing_id().alias("_key"), row.alias("_row"), F.array_distinct(chunks).alias("_chunks"))
    held = F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(F.array(F.lit("")))
    each = F.transform(held, lambda c, i: F.struct(F.when(i == 0, F.col("_row")).alias("row"), F.coalesce(c, F.lit("")).alias("chunk")))
    parts = keyed.select("_key", F.explode(each).alias("_one")).select("_key", F.col("_one.row").alias("_row"), F.col("_one.chunk").alias("chunk"))
    kept = ["_key", "_row", "chunk"]
    for i, (tag, model) in enumerate(models.items()):
        told = F.when(any_in(F.col("chunk"), keywords[tag]), F.col("prediction").cast("int"))
        parts = model.transform(parts).select(*kept, told.alias(f"_{i}"))
        kept.append(f"_{i}")
    found = parts.groupBy("_key").agg(F.first("_row", ignorenulls=True).alias("_row"), *(F.coalesce(F.max(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(models))))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in extracts.columns if c not in models), *(F.col(f"_{i}").alias(tag) for i, tag in enumerate(models)))


def save(models: Mapping[str, PipelineModel], path: str) -> None:
    for tag, model in models.items():
        model.write().overwrite().save(f"{path.rstrip('/')}/{tag}")


def load(path: str, tags: Sequence[str]) -> dict[str, PipelineModel]:
    return {tag: PipelineModel.load(f"{path.rstrip('/')}/{tag}") for tag in tags}
