"""Training data and the true/false-positive classifier (Spark ML)."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import anonymize_context, anonymize_span
from ..schema import TRAINING, VERDICTS
from .classify import recommend_label

# --- Fixed values: entity names of annotated corpora, in our names --------------------------------

CORPUS_TYPES = {
    "SSN": "ssn",
    "SOCIAL_SECURITY_NUMBER": "ssn",
    "NAME": "name",
    "PERSON_NAME": "name",
    "FIRST_NAME": "name",
    "LAST_NAME": "name",
    "EMAIL": "email",
    "EMAIL_ADDRESS": "email",
    "PHONE": "phone",
    "PHONE_NUMBER": "phone",
    "ADDRESS": "address",
    "STREET_ADDRESS": "address",
    "CREDIT_CARD": "credit_card",
    "CREDIT_CARD_NUMBER": "credit_card",
    "MRN": "medical_record_number",
    "MEDICAL_RECORD_NUMBER": "medical_record_number",
    "DOB": "date_of_birth",
    "DATE_OF_BIRTH": "date_of_birth",
    "IP_ADDRESS": "api_key",
    "ACCOUNT_NUMBER": "credit_card",
    "HEALTH_PLAN_ID": "health_plan_id",
}

#: Sentences in which a value is an example, a placeholder or shared contact data, per entity type.
FALSE_POSITIVE_SENTENCES = {
    "ssn": [
        "Sample number [SSN], never issued to anyone",
        "Unit test fixture uses [SSN]",
        "Fill the form with a dummy such as [SSN]",
        "Format check rejects [SSN]",
        "Training slide shows [SSN] as an illustration",
        "Documentation placeholder [SSN]",
    ],
    "email": [
        "Write to [EMAIL] for general enquiries",
        "Placeholder address [EMAIL] in the template",
        "Automated mails are sent from [EMAIL]",
        "Sign in to the demo as [EMAIL]",
        "Replace [EMAIL] with your own address",
        "Regression test mailbox [EMAIL]",
    ],
    "phone": [
        "Our hotline is [PHONE]",
        "Reception desk: [PHONE]",
        "Dummy phone [PHONE] in the sandbox",
        "Fax [PHONE]",
        "Free of charge within the country: [PHONE]",
        "The example shows [PHONE]",
    ],
    "credit_card": [
        "Sandbox payments accept [CREDIT_CARD]",
        "The gateway's test number is [CREDIT_CARD]",
        "Demo checkout with [CREDIT_CARD]",
        "Never charge [CREDIT_CARD], it is a sample",
        "Mock card [CREDIT_CARD]",
    ],
    "name": [
        "Dear [NAME], insert the recipient here",
        "Placeholder person [NAME]",
        "The fictional user [NAME] logs in",
        "Sample row: [NAME]",
    ],
    "address": [
        "Sample address [ADDRESS]",
        "Return parcels to our office, [ADDRESS]",
        "Mock delivery to [ADDRESS]",
        "The form shows [ADDRESS] in grey",
    ],
}

MODEL_VERSION = "1.0.0"


def examples_from_corpus(
    corpus: DataFrame,
    entity_types: list[str] | None = None,
    max_examples: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Annotated texts -> true-positive examples; only the annotated span is replaced in its context."""
    keys = keys or []
    pairs = [F.lit(x) for kv in CORPUS_TYPES.items() for x in kv]
    exploded = corpus.select(*keys, "text", F.inline("entities"))
    ours = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("type")), F.lower("type"))
    rows = exploded.withColumn("entity_type", ours)
    if entity_types:
        rows = rows.filter(F.col("entity_type").isin(entity_types))
    out = rows.select(
        *keys,
        anonymize_span(F.col("text"), F.col("start"), F.col("end"), F.col("entity_type")).alias("text"),
        F.lit(1).alias("label"),
        "entity_type",
        F.lit("corpus").alias("source"),
    )
    return out.limit(max_examples) if max_examples else out


def synthetic_false_positives(seeds: DataFrame, seed_col: str, entity_types: list[str] | None = None) -> DataFrame:
    """One false-positive example per seed row and type, the sentence picked from the seed.

    ``n`` examples per type are ``n`` seed rows; the rows come from any table or from ``spark.range``.
    """
    types = [t for t in (entity_types or FALSE_POSITIVE_SENTENCES) if t in FALSE_POSITIVE_SENTENCES]
    if not types:
        return seeds.sparkSession.createDataFrame([], TRAINING)

    def example(position: int, kind: str) -> Column:
        sentences = FALSE_POSITIVE_SENTENCES[kind]
        mixed = F.pmod(F.col(seed_col), F.lit(2147483648)) * 1103515245 + 12345 * (position + 1)
        pick = F.pmod(F.floor(F.pmod(mixed, F.lit(2147483648)) / 65536).cast("long"), F.lit(len(sentences)))
        return F.struct(
            F.get(F.array(*[F.lit(s) for s in sentences]), pick.cast("int")).alias("text"),
            F.lit(0).alias("label"),
            F.lit(kind).alias("entity_type"),
            F.lit("synthetic_fp").alias("source"),
        )

    return seeds.select(seed_col, F.inline(F.array(*[example(i, k) for i, k in enumerate(types)])))


def examples_from_verdicts(verdicts: DataFrame) -> DataFrame:
    label = F.when(F.col("verdict") == "TP", 1).when(F.col("verdict") == "FP", 0)
    return verdicts.filter(F.col("verdict").isin("TP", "FP")).select(
        F.coalesce("context", F.lit("")).alias("text"),
        label.alias("label"),
        F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"),
        F.lit("user_feedback").alias("source"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Saved verdicts; an absent file or folder is an empty table."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], VERDICTS)
    return spark.read.schema(VERDICTS).json(path)


def save_verdicts(verdicts: DataFrame, path: str) -> None:
    """Append reviewed samples (already anonymised) as JSON lines."""
    verdicts.filter(F.col("verdict").isin("TP", "FP")).select(*VERDICTS.fieldNames()).write.mode("append").json(path)


def clear_verdicts(spark: SparkSession, path: str) -> int:
    """Remove all saved verdicts; returns how many there were."""
    n = read_verdicts(spark, path).count()
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
    return n


def write_examples(examples: DataFrame, path: str) -> None:
    """Write a training set as JSON lines."""
    examples.select(*TRAINING.fieldNames()).write.mode("overwrite").json(path)


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Reproducible shuffle: order by a seeded hash of the whole row."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), *df.columns)


def prepare_dataset(
    corpus_examples: DataFrame,
    false_positives: DataFrame,
    verdicts: DataFrame | None = None,
    shuffle: bool = True,
) -> DataFrame:
    cols = TRAINING.fieldNames()
    parts = corpus_examples.select(*cols).unionByName(false_positives.select(*cols))
    if verdicts is not None:
        parts = parts.unionByName(examples_from_verdicts(verdicts))
    return shuffle_rows(parts) if shuffle else parts


def training_balance(examples: DataFrame) -> DataFrame:
    """Counts by source and class with the totals of both."""
    return examples.rollup("source", "label").agg(F.count(F.lit(1)).alias("n"))


def build_classifier(num_features: int = 1 << 16, max_iter: int = 50) -> Pipeline:
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}_\[\]]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=num_features),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=num_features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.001),
    ]
    return Pipeline(stages=stages)


def _without_summary(stage):
    """The fitted stage without its training summary. That holds the session, which can't be sent to tasks with the model once
    anything in the session has observed a query."""
    if isinstance(stage, LogisticRegressionModel) and stage.hasSummary:
        stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.apply(None))
    return stage


def train_classifier(examples: DataFrame, **options: int) -> tuple[PipelineModel, dict[str, float]]:
    """Fit on 90 % and report accuracy on the rest (seed 42; NaN where no row is left to test on).

    Fitting passes over the examples several times, so they and their word counts are kept (spilling to disk) meanwhile.
    """
    kept = examples.select("text", F.col("label").cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = kept.randomSplit([0.9, 0.1], 42)
    stages = build_classifier(**options).getStages()
    first = next(i for i, stage in enumerate(stages) if isinstance(stage, Estimator))
    counts = PipelineModel(stages[:first]).transform(train).select("label", "tf").persist(StorageLevel.MEMORY_AND_DISK)
    model = PipelineModel([*stages[:first], *map(_without_summary, Pipeline(stages=stages[first:]).fit(counts).stages)])
    counts.unpersist()
    right = (F.col("prediction") == F.col("label")).cast("double")
    accuracy = model.transform(test).agg(F.avg(right)).first()[0]
    kept.unpersist()
    return model, {"accuracy": float("nan") if accuracy is None else accuracy}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``is_true_positive`` and ``tpfp_confidence`` (the larger class probability)."""
    scored = model.transform(df)
    internal = [c for c in scored.columns if c not in df.columns]
    return scored.select(
        *df.columns,
        (F.col("prediction") == 1.0).alias("is_true_positive"),
        F.array_max(vector_to_array("probability")).alias("tpfp_confidence"),
    ) if internal else scored


def apply_classifier(
    files: DataFrame, model: PipelineModel, threshold: float = 0.5, version: str = MODEL_VERSION
) -> DataFrame:
    """Flag matches the model takes for false positives, and label again.

    Flags are only ever set. One pass: files are exploded into matches (a file without any keeps one row), scored in
    parallel, and put together by a row id that no other file shares, so files of several scans may have one path. The
    detection below runs once, and document bodies don't travel.
    """
    rest = [c for c in files.columns if c != "matches"]
    numbered = files.select(F.monotonically_increasing_id().alias("_row"), F.struct(*rest).alias("_file"), "matches")  # before the matches are taken apart
    rows = numbered.select("_row", "_file", F.posexplode_outer("matches").alias("_pos", "_m"))
    context = anonymize_context(F.col("_m.context"), F.col("_m.value"), F.col("_m.entity_type"))
    scored = predict(model, rows.withColumn("text", F.coalesce(context, F.lit(""))))
    wrong = ~F.col("is_true_positive") & (F.col("tpfp_confidence") >= threshold)
    flagged = F.col("_m").withField("is_test_data", F.col("_m.is_test_data") | wrong).withField("model_version", F.lit(version))
    grouped = scored.groupBy("_row").agg(
        F.first("_file").alias("_file"),
        F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("pos"), flagged.alias("m"))))).alias("_found"),
    )
    back = grouped.select("_file.*", F.transform("_found", lambda x: x["m"]).alias("matches"))
    return back.withColumn("label_recommendation", recommend_label(F.col("matches"))).select(*files.columns)


def save_model(spark: SparkSession, model: PipelineModel, path: str, version: str = MODEL_VERSION) -> None:
    model.write().overwrite().save(f"{path}/pipeline")
    meta = json.dumps({"base_model": "hashed n-grams + logistic regression", "version": version})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return PipelineModel.load(f"{path}/pipeline"), meta
