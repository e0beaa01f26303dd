"""Inference-harness operators: prompts, pending work, wide tables of responses and metrics, run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import METHODS, finite, is_error, method_name

# Where a mode takes its text from, and the settings of generation.
MODES = {"nlq": ("question", "_NLQ"), "nlq_cot": ("question", "_NLQ_COT"), "sparql": ("sparql_query", "_SPARQL"), "sparql_cot": ("sparql_query", "_SPARQL_COT")}
GENERATION = {"temperature": 0.75, "top_p": 0.9, "top_k": 50, "repetition_penalty": 1.3, "max_new_tokens": 1024, "max_input_tokens": 1600}
# Chat templates by family of models.
CHAT_TEMPLATES = {
    "gemma": "<start_of_turn>user\n{prompt}<end_of_turn>\n<start_of_turn>model\n",
    "mistral": "<s>[INST] {prompt} [/INST]",
    "codellama": "[INST] {prompt} [/INST]",
    "llama3": "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n{prompt}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n",
    "qwen": "<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n",
    "qwen-coder": "<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n",
    "pythia": "Query: {prompt}\nResponse:",
    "opt": "Query: {prompt}\nResponse:",
}
METRICS = ("input_length", "generated_length", "generation_time_seconds", "confidence_score")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no finished result."""
    return todo.join(done.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def prompt(blocks: dict[str, list[str]], method: Column, query_id: Column, query: Column) -> Column:
    """Prompt text by method: the method's blocks, then id, query and answer cue, one per line. An unknown method gives null."""
    out = F.lit(None).cast("string")
    for m, parts in blocks.items():
        out = F.when(method == m, F.concat_ws("\n", *[F.lit(p) for p in parts], F.concat(F.lit("ID: "), query_id.cast("string")), F.concat(F.lit("QUERY: "), F.coalesce(query, F.lit(""))), F.lit("THINK:" if m.endswith("cot") else "ANSWER:"))).otherwise(out)
    return out


def wrapped(df: DataFrame, templates: DataFrame, model: str, text: str) -> DataFrame:
    """Prompts in their model's chat template; the mark {prompt} is replaced, models without a template keep the text.

    templates: (model, template), one row per model."""
    t = templates.select(F.col("model").alias("_m"), "template")
    j = df.join(t, df[model] == t["_m"], "left").drop("_m")
    return j.withColumn("wrapped", F.coalesce(F.replace(F.col("template"), F.lit("{prompt}"), F.col(text)), F.col(text))).drop("template")


def metric_pivot(metrics: DataFrame) -> DataFrame:
    """(model, query_id, {method}_{metric}): one row per model and query with the metrics of each method, null where a method is missing or
    a value is not finite.

    Of repeated rows the one processed last counts, then the greatest row."""
    m = metrics.withColumn("method", method_name("query_mode")).filter(F.col("method").isin(*METHODS))
    m = m.withColumns({c: finite(F.col(c)) for c in METRICS if m.schema[c].dataType.typeName() in ("double", "float")})
    last = m.groupBy("model", "query_id", "method").agg(F.max(F.struct("processing_timestamp", *METRICS)).alias("r"))
    wide = last.groupBy("model", "query_id").pivot("method", list(METHODS)).agg(*[F.first(f"r.{c}").alias(c) for c in METRICS])
    return wide


def response_union(long: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, question, {method}_response): all keys of any method; the question is that of the first method that has one.

    long: key, method, question, response."""
    q = F.when(F.trim("question") != "", F.col("question"))
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return long.groupBy(key).agg(F.min_by(q, F.when(q.isNotNull(), order)).alias("question"), *[F.max(F.when(F.col("method") == m, F.col("response"))).alias(f"{m}_response") for m in METHODS])


def run_counts(results: DataFrame, keys: list[str], response: str) -> DataFrame:
    """(keys, total, successful, errors) of result records."""
    c = results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(is_error(F.col(response))).alias("errors"))
    return c.select(*keys, "total", (F.col("total") - F.col("errors")).alias("successful"), "errors")


def method_averages(metrics: DataFrame) -> DataFrame:
    """(method, n, mean time, mean confidence, mean length)."""
    m = metrics.withColumn("method", method_name("query_mode")).filter(F.col("method").isNotNull())
    conf = F.when(~F.isnan("confidence_score"), F.col("confidence_score"))
    return m.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("generation_time_seconds"), 4).alias("mean_seconds"), F.round(F.avg(conf), 4).alias("mean_confidence"), F.round(F.avg("generated_length"), 2).alias("mean_length"))


def first_loaded(loaders: list):
    """What the first loader that does not fail gives (four bits, eight bits, processor, say); the last failure if all do."""
    failure: Exception | None = None
    for load in loaders:
        try:
            return load()
        except Exception as ex:  # noqa: BLE001
            failure = ex
    raise failure if failure else ValueError("no loader")


def guarded(df: DataFrame, source: Column, method: Column, response: str) -> DataFrame:
    """df with an error record as response where the mode's source text is null or blank; other responses stay."""
    empty = F.trim(F.coalesce(source, F.lit(""))) == ""
    return df.withColumn(response, F.when(empty, F.concat(F.lit("ERROR: empty source for mode "), method)).otherwise(F.col(response)))


def head(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in an order, as many as a run is allowed to take."""
    return df.orderBy(*order).limit(most)


def generate(prompts: DataFrame, provider, text: str, retries: int = 1) -> DataFrame:
    """prompts with generated_response by provider(list of texts) -> list of texts, batch by batch; a failing batch is retried, then gives
    error records. Without a provider the column is null."""
    if provider is None:
        return prompts.withColumn("generated_response", F.lit(None).cast("string"))
    spec = prompts.withColumn("generated_response", F.lit("")).schema

    def run(batches):
        for b in batches:
            for left in range(retries, -1, -1):
                try:
                    out = provider(b[text].tolist())
                    break
                except Exception as ex:  # noqa: BLE001
                    out = [f"ERROR: {ex}"] * len(b)
            yield b.assign(generated_response=out)

    return prompts.mapInPandas(run, spec)


def last_truth(df: DataFrame, key: str, text: str, order: str, default: str = "[EMPTY]") -> DataFrame:
    """(key, text): the last loaded text per key, the default where it is null or blank."""
    last = df.groupBy(key).agg(F.max(F.struct(order, text)).alias("r"))
    t = F.col(f"r.{text}")
    return last.select(key, F.when(t.isNull() | (F.trim(t) == ""), default).otherwise(t).alias(text))
