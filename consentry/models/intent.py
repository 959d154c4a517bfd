"""Intent classification of bilingual messages: TF-IDF over words and word pairs, and a
multinomial logistic regression, as a Spark ML pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer,
    RegexTokenizer, SQLTransformer, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_INTENT = "general_faq"

# The labelled phrases the classifier is trained on.
PHRASES: dict[str, tuple[str, ...]] = {
    "view_data": (
        "show my details",
        "what information do you store about me?",
        "view profile",
        "nataka kuona data yangu",
        "onyesha habari zangu",
        "angalia data yangu ya kibinafsi",
        "check my information",
        "retrieve profile details",
        "nipe maelezo yangu",
        "show records",
        "show profile for joseph",
        "angalia habari zangu",
    ),
    "update_consent": (
        "i want to grant consent",
        "give permission to process my data",
        "withdraw consent",
        "nataka kuondoa kibali changu",
        "ondoa ridhaa yangu",
        "peana kibali",
        "change my consent preferences",
        "opt out",
        "opt in",
        "kubali maombi ya ridhaa",
        "withdraw consent for asha",
    ),
    "request_deletion": (
        "delete my personal data",
        "erase my details from your database",
        "right to be forgotten request",
        "futa kabisa habari zangu",
        "toa faili langu kwenye mfumo",
        "forget me",
        "scrub my record",
        "futa profile",
        "nataka mfutie data yangu",
        "delete my beneficiary account",
        "delete data for joseph",
        "delete my record for joseph",
        "nataka kufuta maelezo yangu",
        "kufuta",
        "futa",
        "futa data yangu",
    ),
    "general_faq": (
        "is my data safe with you?",
        "how do you protect my privacy?",
        "sheria ya KDPA inasemaje?",
        "kpc inalinda vipi habari zangu?",
        "privacy policy information",
        "tell me about data protection regulations",
        "are my details encrypted?",
        "who has access to my PII?",
        "kibali changu kinatumika wapi?",
        "rights of data subject under Kenya Data Protection Act",
        "jinsi ya kulinda data yangu?",
    ),
    "generate_report": (
        "report on the tech pillar",
        "give me a report on vocational",
        "scholarship pillar status",
        "nyanza region audit report",
        "generate report for plus pillar",
        "ripoti ya pillar ya tech",
        "ripoti ya nyanza",
        "show stats for nairobi",
        "compliance report for eastern",
        "stats for rift valley",
        "western region status",
        "central pillar audit",
        "coastal region report",
        "north eastern report",
        "generate report",
    ),
}


def phrases(spark: SparkSession) -> DataFrame:
    rows = [(text, intent) for intent, texts in PHRASES.items() for text in texts]
    return spark.createDataFrame(rows, "text string, intent string").coalesce(1)


def _grams() -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _grams FROM __THIS__"),
    ]


def fit(
    labelled: DataFrame, max_vocabulary: int = 1 << 18, hashed: int | None = None
) -> PipelineModel:
    """Train on ``(text, intent)``.

    Inverse document frequencies are smoothed and shifted by one, vectors have unit length, and
    the penalty is that of C = 1: half the squared weights against the summed loss. The model, a
    weight per feature and intent, is held by the driver. No gram is left out.

    The caller says what a feature is, whatever the size of the input. With ``hashed`` all grams of
    all rows are hashed to so many features, which bounds the model, and grams that share a feature
    share its weight. Without it every gram is a feature, for curated rows: more than
    ``max_vocabulary`` grams are refused with ``ValueError``.
    """
    labelled = labelled.select("text", "intent").persist()
    try:
        size = labelled.count()
        if hashed is None:
            counter = CountVectorizer(
                inputCol="_grams", outputCol="_counts", vocabSize=max_vocabulary + 1)
        else:
            counter = HashingTF(numFeatures=hashed, inputCol="_grams", outputCol="_counts")
        counts = Pipeline(stages=[*_grams(), counter]).fit(labelled)
        if hashed is None and len(counts.stages[-1].vocabulary) > max_vocabulary:
            raise ValueError(
                f"the labelled rows hold more than {max_vocabulary} grams; fit on fewer rows, "
                "raise max_vocabulary or let them be hashed")
        idf = IDF(inputCol="_counts", outputCol="_x").fit(counts.transform(labelled)).idf
        weigh = ElementwiseProduct(
            inputCol="_counts", outputCol="_weighted",
            scalingVec=Vectors.dense(np.asarray(idf) + 1.0),
        )
        indexer = StringIndexer(
            inputCol="intent", outputCol="_label", stringOrderType="alphabetAsc"
        ).fit(labelled)
        classify = LogisticRegression(
            featuresCol="_features", labelCol="_label", predictionCol="_predicted",
            rawPredictionCol="_raw", probabilityCol="_probability", family="multinomial",
            regParam=1.0 / size, elasticNetParam=0.0, standardization=False,
            maxIter=100, tol=1e-6,
        )
        normalise = Normalizer(p=2.0, inputCol="_weighted", outputCol="_features")
        ready = normalise.transform(weigh.transform(counts.transform(labelled)))
        classifier = classify.fit(indexer.transform(ready))
        name = IndexToString(
            inputCol="_predicted", outputCol="intent", labels=list(indexer.labels)
        )
        return PipelineModel([*counts.stages, weigh, normalise, classifier, name])
    finally:
        labelled.unpersist()


def predict(messages: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``intent``. Without a model every message is a general question."""
    if model is None:
        return messages.withColumn("intent", F.lit(DEFAULT_INTENT))
    return model.transform(messages).select(*messages.columns, "intent")


def weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The model as rows ``(intent, gram, weight)``."""
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    labels = model.stages[-1].getLabels()
    matrix = model.stages[-2].coefficientMatrix.toArray()
    rows = [
        (label, gram, float(matrix[i, j]))
        for i, label in enumerate(labels) for j, gram in enumerate(vocabulary)
    ]
    return spark.createDataFrame(rows, "intent string, gram string, weight double")


def gram_weights(labelled: DataFrame, model: PipelineModel) -> DataFrame:
    """The model as rows ``(intent, gram, weight)``, for all grams of ``labelled``.

    Grams are counted and weighed by executors: a gram alone has its weights as margins, less the
    intercepts.
    """
    tokens, counter = PipelineModel(model.stages[:3]), model.stages[3]
    classifier, labels = model.stages[-2], model.stages[-1].getLabels()
    grams = tokens.transform(labelled.select("text")).select(
        F.explode("_grams").alias("gram")).distinct()
    alone = counter.transform(grams.withColumn("_grams", F.array("gram")))
    margins = classifier.transform(alone.withColumn("_features", F.col("_counts")))
    # Rows of one intent have an infinite intercept and no weights.
    intercepts = [float(b) for b in classifier.interceptVector]
    each = F.arrays_zip(
        F.array(*map(F.lit, labels)).alias("intent"), vector_to_array("_raw").alias("margin"),
        F.array(*map(F.lit, intercepts)).alias("intercept"))
    finite = F.abs(F.col("e.intercept")) < float("inf")
    return margins.select("gram", F.explode(each).alias("e")).select(
        "e.intent", "gram",
        F.when(finite, F.col("e.margin") - F.col("e.intercept")).otherwise(0.0).alias("weight"))


_FITTED: dict[str, PipelineModel] = {}


def default_model(spark: SparkSession) -> PipelineModel:
    """The model of the fixed phrases, trained once per application."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        _FITTED.clear()
        _FITTED[app] = fit(phrases(spark))
    return _FITTED[app]
