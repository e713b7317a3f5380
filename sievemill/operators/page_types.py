"""A page-type model of one's own, trained with Spark's ML library, and its vote with the heuristics.

    model = train(pages, "kind")                      # labelled pages
    typed = vote(classify(model, pages))              # page_type, classification_confidence
    extract(typed, page_type="page_type")

Features are the numbers of features.NAMES and TF-IDF of title and description.
Without a model the heuristics of the URL and the page decide alone.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c
from . import metadata as M
from . import values as V
from .dom import parse
from .features import features
from .stage import _map

FIELDS = [T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("title_text", T.StringType()), T.StructField("url_type", T.StringType()), T.StructField("refined_type", T.StringType())]


def described(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with features, title_text (title and description), url_type and refined_type; html stays."""

    def record(page, own):
        doc = parse(page)
        body = next(n for n in doc.elements() if n.tag == "body")
        m = M.metadata(doc, body, own)
        kind = V.url_type(own)
        return [{"features": features(doc, body, m["og_type"], own), "title_text": f"{m['title'] or ''} {m['description'] or ''}".strip(), "url_type": kind, "refined_type": M.refine(kind, M.signals(doc, body, m["og_type"]))}]

    return _map(pages.withColumn("__html", F.col(html)), "__html", url, FIELDS, record)


def _inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("__numbers", array_to_vector("features"))


def train(pages: DataFrame, label: str, html: str = "html", url: str = "url", trees: int = 60, text_slots: int = 256, seed: int = 7) -> PipelineModel:
    """A random forest over the features and TF-IDF of title and description; label holds page types."""
    rows = _inputs(described(pages.where(F.col(label).isNotNull()), html, url)).withColumnRenamed(label, "__label")
    model = Pipeline(stages=[
        StringIndexer(inputCol="__label", outputCol="__y", stringOrderType="alphabetAsc"),
        Tokenizer(inputCol="title_text", outputCol="__words"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=text_slots),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        VectorAssembler(inputCols=["__numbers", "__tfidf"], outputCol="__x"),
        RandomForestClassifier(featuresCol="__x", labelCol="__y", predictionCol="__k", probabilityCol="__p", rawPredictionCol="__raw", numTrees=trees, maxDepth=8, seed=seed),
    ]).fit(rows)
    model.stages[-1]._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())  # it holds the training rows and their session, which tasks cannot take along
    return model


def classify(model: PipelineModel, pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with url_type, refined_type, model_type and model_confidence (the share of the trees)."""
    kinds = F.array(*(F.lit(x) for x in model.stages[0].labels))
    rest = PipelineModel(model.stages[1:])
    rows = rest.transform(_inputs(described(pages, html, url)))
    return rows.select(*pages.columns, "url_type", "refined_type", F.element_at(kinds, F.col("__k").cast("int") + 1).alias("model_type"), F.array_max(vector_to_array("__p")).alias("model_confidence"))


def voted(url_type, refined_type, model_type, model_confidence) -> Column:
    """Struct page_type, classification_confidence: the URL's type or else the page's, where the model agrees; else the model's."""
    url, refined, model = c._c(url_type), c._c(refined_type), c._c(model_type)
    kind = F.when((url != "article") & (url == model), url).when((refined != "article") & (refined == model), refined).otherwise(model)
    sure = F.when((url != "article") & (url == model), F.lit(1.0)).when((refined != "article") & (refined == model), F.lit(0.95)).otherwise(c._c(model_confidence))
    return F.struct(kind.alias("page_type"), sure.alias("classification_confidence"))


def vote(typed: DataFrame) -> DataFrame:
    """What classify gives, with page_type and classification_confidence."""
    return typed.withColumn("__v", voted("url_type", "refined_type", "model_type", "model_confidence")).select(*typed.columns, "__v.*")


def type_scores(scored: DataFrame, page_type: str = "page_type", score: str = "fscore") -> DataFrame:
    """Macro scores: the mean by page type, and over the types (page_type null)."""
    by = scored.groupBy(page_type).agg(F.count(F.lit(1)).alias("pages"), F.avg(score).alias("mean_score"))
    return by.unionByName(by.agg(F.lit(None).cast("string").alias(page_type), F.sum("pages").alias("pages"), F.avg("mean_score").alias("mean_score")))
