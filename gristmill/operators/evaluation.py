"""Evaluation of predictions, comparison of reports, and the tables around training: all relational.

Scores of a language model enter as a table; the models themselves are no part of this engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X

#: Kinds of items, metrics of reports, and the domain of items that name none.
TASKS = ("text", "multiple_choice", "qa", "generation")
#: Where the report of one section holds numbers that can be compared; the last two only under one tokenizer.
TEXT_METRICS = ("bits_per_byte", "ce", "perplexity")
TASK_METRICS = ("accuracy", "exact_match", "character_f1", "mean_repetition", "eos_rate")
TOKENIZER_BOUND = ("ce", "perplexity")
DEFAULT_DOMAIN = "korean_general"


def suite_problems(suite: DataFrame) -> DataFrame:
    """(id, problem) of items that no evaluation accepts; none, if the suite is sound."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problem = (
        F.when(F.col("id").isNull(), "missing id")
        .when(F.col("copies") > 1, "repeated id")
        .when(~F.col("type").isin(*TASKS) | F.col("type").isNull(), "unknown type")
        .when((F.col("type") == "text") & blank("text"), "empty text")
        .when((F.col("type") != "text") & blank("prompt"), "empty prompt")
        .when((F.col("type") == "multiple_choice") & (F.coalesce(F.size("choices"), F.lit(-1)) < 2), "fewer than two choices")
        .when((F.col("type") == "multiple_choice") & ~F.coalesce((F.col("answer_index") >= 0) & (F.col("answer_index") < F.size("choices")), F.lit(False)), "answer index")
        .when((F.col("type") == "qa") & (F.coalesce(F.size("answers"), F.lit(-1)) < 1), "no answers")
    )
    counted = suite.join(suite.groupBy("id").agg(F.count("*").alias("copies")), "id", "left")
    return counted.withColumn("problem", problem).where("problem is not null").select("id", "problem")


def domain_of(domain: Column) -> Column:
    return F.coalesce(domain, F.lit(DEFAULT_DOMAIN))


def answer_scores(answered: DataFrame) -> DataFrame:
    """(id, exact_match, character_f1): best over the answers of rows (id, prediction, answers).

    The character overlap is one of multisets: for every character of the prediction the lesser count, summed. Two empty strings
    agree wholly; a row without answers scores 0.
    """
    pairs = answered.select("id", "prediction", F.explode_outer("answers").alias("answer")).select(
        "id", X.folded_answer(F.col("prediction")).alias("p"), X.folded_answer(F.col("answer")).alias("g"), F.col("answer").isNotNull().alias("given")
    )
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.array_distinct(letters(F.col("p"))), F.lit(0), lambda a, c: a + F.least(count(F.col("p"), c) / F.length(c), count(F.col("g"), c) / F.length(c)).cast("int"))
    total = F.length("p") + F.length("g")
    f1 = F.when(~F.col("given"), 0.0).when(total == 0, 1.0).otherwise(2 * common / total)
    em = F.when(F.col("given") & (F.col("p") == F.col("g")), 1.0).otherwise(0.0)
    return pairs.groupBy("id").agg(F.max(em).alias("exact_match"), F.max(f1).alias("character_f1"))


def first_best(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def suite_predictions(suite: DataFrame, windows: DataFrame, choices: DataFrame, generated: DataFrame) -> DataFrame:
    """One row an item of a suite, by its type: (id, type, domain, nll, tokens, utf8_bytes, scores, predicted_index, correct, prediction, eos, repetition,
    exact_match, character_f1), null where a type has no use for a column.

    A model's part comes as tables: ``windows`` (id, nll, tokens) of the windows of texts, ``choices`` (id, choice, score) with the whole log-likelihood
    of each choice by its number from 0, ``generated`` (id, prediction, eos). A suite without items, with an item that ``suite_problems`` names, or with
    one that nothing was scored for is refused.
    """
    if suite.isEmpty():
        raise ValueError("the suite has no items")
    bad = suite_problems(suite).limit(5).collect()
    if bad:
        raise ValueError("unsound items: " + ", ".join(f"{r['id']}: {r['problem']}" for r in bad))
    texts = windows.groupBy("id").agg(F.sum("nll").alias("nll"), F.sum("tokens").cast("bigint").alias("tokens"))
    listed = choices.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("choice", "score"))), lambda x: x["score"]).alias("scores"))  # as many as an item has choices
    made = generated.select("id", "prediction", F.col("eos").cast("boolean").alias("eos"), X.repetition(F.col("prediction")).alias("repetition"))
    asked = suite.where("type = 'qa'").join(generated.select("id", "prediction"), "id").select("id", "prediction", "answers")
    of = lambda kind, c: F.when(F.col("type").isin(*kind), F.col(c))
    base = suite.select("id", "type", domain_of(F.col("domain")).alias("domain"), F.when(F.col("type") == "text", F.octet_length("text").cast("bigint")).alias("utf8_bytes"), "answer_index", F.size("choices").alias("_n"))
    joined = base.join(texts, "id", "left").join(listed, "id", "left").join(made, "id", "left").join(answer_scores(asked), "id", "left")
    scored = F.when(F.col("type") == "text", F.coalesce(F.col("tokens") > 0, F.lit(False))).when(F.col("type") == "multiple_choice", F.size("scores") == F.col("_n")).otherwise(F.col("prediction").isNotNull())
    kind = F.when(scored, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("nothing was scored for "), "id")))
    told, chosen, free = ("text",), ("multiple_choice",), ("qa", "generation")
    best = F.when(F.col("type") == "multiple_choice", first_best(F.col("scores")))
    return joined.withColumn("type", kind).select(
        "id", "type", "domain", of(told, "nll").alias("nll"), of(told, "tokens").alias("tokens"), "utf8_bytes", of(chosen, "scores").alias("scores"), best.alias("predicted_index"),
        (best == F.col("answer_index")).alias("correct"), of(free, "prediction").alias("prediction"), of(free, "eos").alias("eos"), of(free, "repetition").alias("repetition"), "exact_match", "character_f1",
    )


def text_metrics(scored: DataFrame) -> DataFrame:
    """(domain, nll, tokens, utf8_bytes, ce, perplexity, bits_per_byte) from rows (domain, nll, tokens, utf8_bytes): sums first, then
    ratios. A perplexity beyond exp(700) is null."""
    total = scored.groupBy(domain_of(F.col("domain")).alias("domain")).agg(*[F.sum(c).alias(c) for c in ("nll", "tokens", "utf8_bytes")])
    ce = F.col("nll") / F.col("tokens")
    return total.withColumns({"ce": ce, "perplexity": F.when(ce < 700, F.exp(ce)), "bits_per_byte": F.col("nll") / (F.col("utf8_bytes") * math.log(2))})


def task_metrics(results: DataFrame) -> DataFrame:
    """(task, count, accuracy, exact_match, character_f1, mean_repetition, eos_rate) from rows (domain, type, correct, exact_match,
    character_f1, repetition, eos); what a type has no use for stays null."""
    chosen, asked, made = F.col("type") == "multiple_choice", F.col("type") == "qa", F.col("type").isin("qa", "generation")
    mean = lambda when, c: F.avg(F.when(when, F.col(c).cast("double")))
    return results.where("type <> 'text'").groupBy(F.concat_ws(":", domain_of(F.col("domain")), "type").alias("task")).agg(
        F.count("*").alias("count"), mean(chosen, "correct").alias("accuracy"), mean(asked, "exact_match").alias("exact_match"),
        mean(asked, "character_f1").alias("character_f1"), mean(made, "repetition").alias("mean_repetition"), mean(made, "eos").alias("eos_rate"),
    )


def macro_average(task_report: DataFrame, metric: str) -> DataFrame:
    """(type, macro): mean of the domains' means for each task type."""
    return task_report.where(F.col(metric).isNotNull()).groupBy(F.element_at(F.split("task", ":"), -1).alias("type")).agg(F.avg(metric).alias("macro"))


def long_report(text_report: DataFrame, task_report: DataFrame) -> DataFrame:
    """(section, key, metric, value) of both parts of a report."""
    spread = lambda df, section, key, metrics: df.select(
        F.lit(section).alias("section"), F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    ).select("section", "key", "m.metric", "m.value")
    return spread(text_report, "text", "domain", TEXT_METRICS).unionAll(spread(task_report, "tasks", "task", TASK_METRICS)).where("value is not null")


def compare_reports(before: DataFrame, after: DataFrame, same_tokenizer: bool) -> DataFrame:
    """(section, key, metric, before, after, delta), delta being after minus before, of two long reports.

    Both must cover the same sections and keys, else the comparison is refused. Numbers that depend on the tokenizer are left out if it
    is not the same."""
    if not uneven_keys(before, after, "section", "key").isEmpty():
        raise ValueError("the reports cover different domains or tasks")
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["section", "key", "metric"])
    if not same_tokenizer:
        joined = joined.where(~F.col("metric").isin(*TOKENIZER_BOUND))
    return joined.select("section", "key", "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def same_protocol(before: dict, after: dict) -> bool:
    """Whether two reports' provenance allows a comparison; raises if the protocol differs. The result: the same tokenizer."""
    for k in ("suite_sha256", "max_new_tokens", "choice_scoring", "qa_scoring"):
        if before[k] != after[k]:
            raise ValueError(f"the protocols differ in {k}")
    return before["tokenizer_sha256"] == after["tokenizer_sha256"]


def token_weighted(micro: DataFrame) -> DataFrame:
    """(step, ce): cross-entropy of a step over its micro-batches (step, ce_sum, tokens), each token counting once."""
    return micro.groupBy("step").agg((F.sum("ce_sum") / F.sum("tokens")).alias("ce"))


def bootstrap_interval(paired: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean difference of paired scores (id, before, after) by the Poisson bootstrap: every
    row draws for itself how often it counts in each round, by a hash, so nothing is resampled across the cluster."""
    unit = (F.pmod(F.xxhash64("id", "round", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    times, total = F.lit(0), 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        times = times + (unit > total).cast("int")
    drawn = paired.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("times", times)
    means = drawn.groupBy("round").agg((F.sum((F.col("after") - F.col("before")) * F.col("times")) / F.sum("times")).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def latency(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, p50, p95) of a duration."""
    return events.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


# ---- training tables --------------------------------------------------------------------------------------------------------


def parameter_count() -> Column:
    """Parameters of a decoder from a row of its configuration."""
    d, h = F.col("hidden_size"), F.col("head_dim")
    attention = 2 * d * F.col("num_attention_heads") * h + 2 * d * F.col("num_key_value_heads") * h
    norms = 2 * d + F.when(F.col("qk_norm") != "none", 2 * h).otherwise(0)
    embedding = F.col("vocab_size") * d * F.when(F.col("tie_word_embeddings"), 1).otherwise(2)
    return embedding + F.col("num_hidden_layers") * (attention + 3 * d * F.col("intermediate_size") + norms) + d


def budget(configs: DataFrame, tokens: int, batch: int, sequence: int, accumulation: int, tokens_per_second: float | None = None) -> DataFrame:
    """Sizes and durations of a training run for each row of configurations."""
    if min(tokens, batch, sequence, accumulation) <= 0:
        raise ValueError("all counts are positive")
    p, gib = F.col("parameters"), float(1 << 30)
    kv = 2 * F.col("num_hidden_layers") * batch * sequence * F.col("num_key_value_heads") * F.col("head_dim") * 2
    step = batch * sequence * accumulation
    return configs.withColumn("parameters", parameter_count().cast("bigint")).select(
        "profile", "parameters", (16 * p / gib).alias("training_state_gib"), (2 * p / gib).alias("weights_gib"), (kv / gib).alias("kv_gib"),
        F.lit(step).cast("bigint").alias("tokens_per_update"), F.lit(-(-tokens // step)).cast("bigint").alias("updates"), (6.0 * p * tokens).alias("flops"),
        F.lit(tokens / tokens_per_second / 3600 if tokens_per_second else None).cast("double").alias("hours"),
    )


def cost(plans: DataFrame) -> DataFrame:
    """(plan, training_hours, run_hours, device_cost, total_cost) of plans (plan, tokens, tokens_per_second of all devices, margin, devices,
    hourly_rate of one, storage, transfer, preparation): hours of training proper, with the margin for what comes beside, and what they cost."""
    training = F.col("tokens") / F.col("tokens_per_second") / 3600
    run = training * F.col("margin")
    device = F.col("hourly_rate") * F.col("devices") * run
    total = device + F.col("storage") + F.col("transfer") + F.col("preparation")
    return plans.select("plan", training.alias("training_hours"), run.alias("run_hours"), device.alias("device_cost"), total.alias("total_cost"))


def learning_rate(steps: DataFrame, total: int, warmup_ratio: float = 0.01, floor: float = 0.1) -> DataFrame:
    """(step, multiplier): a straight rise over the first steps (at least one, none at ratio 0), then half a cosine wave that ends at
    ``floor`` on the last step."""
    problems = [what for what, bad in (("total", total < 1), ("warmup_ratio", not 0 <= warmup_ratio < 1), ("floor", not 0 <= floor <= 1)) if bad]
    if problems:
        raise ValueError("out of range: " + ", ".join(problems))
    rise = 0 if warmup_ratio == 0 else max(1, math.floor(total * warmup_ratio))
    fall = total - rise - 1  # steps from the crest to the last one
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("step") - rise) / float(fall if fall > 0 else 1)))
    half_wave = (F.cos(done * F.pi()) + 1) / 2
    falling = half_wave * (1 - floor) + floor
    rising = (F.col("step") + 1) / F.lit(float(rise or 1))
    return steps.select("step", F.when(F.col("step") >= rise, falling).otherwise(rising).alias("multiplier"))


def log_totals(log: DataFrame) -> DataFrame:
    """Running totals of a training log (run, step, tokens, validation_ce): tokens seen, best validation so far, and whether a step
    is a measuring point (each 10th or the last)."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("step").over(Window.partitionBy("run"))
    return log.select(
        "run", "step", F.sum("tokens").over(w).alias("tokens_seen"), F.min("validation_ce").over(w).alias("best_ce"), ((F.col("step") % 10 == 0) | (F.col("step") == last)).alias("measured")
    )


def sft_rows(pairs: DataFrame, bos: int, user: int, end: int, assistant: int, eos: int, limit: int) -> DataFrame:
    """(id, input_ids, loss_mask) of pairs (id, prompt_ids, response_ids): the loss counts the answer and its end only. A row longer
    than ``limit`` fails the query; nothing is cut."""
    head = F.concat(F.array(F.lit(bos), F.lit(user)), "prompt_ids", F.array(F.lit(end), F.lit(assistant)))
    tail = F.concat("response_ids", F.array(F.lit(eos)))
    ids = F.concat(head, tail)
    fits = F.when(F.size(ids) > limit, F.raise_error(F.lit("an example is longer than the context"))).otherwise(ids)
    return pairs.select("id", fits.alias("input_ids"), F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(F.lit(1), F.size(tail))).alias("loss_mask"))


def keep_mask(document_ids: Column, attention_mask: Column, loss_mask: Column) -> Column:
    """1 for each target (the second of two neighbours of one document, both present) that counts for the loss."""
    return F.transform(
        F.sequence(F.lit(1), F.size(document_ids) - 1),
        lambda i: ((document_ids[i] == document_ids[i - 1]) & (attention_mask[i] == 1) & (attention_mask[i - 1] == 1) & (loss_mask[i] == 1)).cast("int"),
    )


def causal_pairs(places: DataFrame) -> DataFrame:
    """(row, query, key): what each place of a packed row may see: earlier or equal places of the same document. The join is on row and
    document, so it is as large as the rows are long, not as the corpus."""
    q, k = places.alias("q"), places.alias("k")
    same = (F.col("q.row") == F.col("k.row")) & (F.col("q.document") == F.col("k.document")) & (F.col("k.place") <= F.col("q.place"))
    return q.join(k, same).where(F.col("q.document").cast("string") != "-1").select(F.col("q.row").alias("row"), F.col("q.place").alias("query"), F.col("k.place").alias("key"))


# ---- sets -------------------------------------------------------------------------------------------------------------------


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values that both tables hold."""
    return left.select(column).where(F.col(column).isNotNull()).distinct().join(right.select(column), column, "left_semi")


def refuse_overlap(train: DataFrame, validation: DataFrame, column: str = "prompt") -> None:
    """Raises if train and validation share a value, as prompts of fine-tuning must not."""
    shared = overlap(train, validation, column).count()
    if shared:
        raise ValueError(f"train and validation share {shared} values of {column}")


def suite_from(validation: DataFrame, prompts: DataFrame) -> DataFrame:
    """Text items of validation records (id, domain, text), and all of the fixed prompts (id, type, domain, prompt)."""
    texts = validation.select(F.concat(F.lit("text-"), F.col("id")).alias("id"), F.lit("text").alias("type"), "domain", "text")
    return texts.unionByName(prompts, allowMissingColumns=True)


def uneven_keys(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, side) of keys that only one table has."""
    b, a = before.select(*keys).distinct().withColumn("in_before", F.lit(True)), after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    joined = b.join(a, list(keys), "full_outer")
    return joined.where("in_before is null or in_after is null").select(*keys, F.when(F.col("in_after").isNull(), "before").otherwise("after").alias("side"))
