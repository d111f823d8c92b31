"""Features of instances, diagnostics of types, selectors that name every key, controls and contrasts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .cuts import kept
from .quantiles import quantiles
from .receipts import ReceiptError

#: The prompts of the question lane, with and without a context, and that of the concept lane.
CONTEXT_PROMPT = """Answer the question using only the context. Reply with a short answer span only. If the question is unanswerable from the context, reply with 'unanswerable'.

Context: {context}

Question: {question}

Answer:"""
PLAIN_PROMPT = """Answer the biomedical factoid question with a short exact answer only. Do not explain.

Question: {question}

Answer:"""
CONCEPT_PROMPT = """Identify the primary medical concept in the following clinical text. Reply with only the concept name.

Text: {text}"""


def filled(template: str, **values: Column) -> Column:
    """A template with its named slots filled; null where a value is. What stands in a value is no slot."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def prompt(question: Column, context: Column) -> Column:
    """The question with its context, or alone where that is null or empty (STR-16)."""
    return F.when(F.coalesce(context, F.lit("")) != "", filled(CONTEXT_PROMPT, context=context, question=question)).otherwise(filled(PLAIN_PROMPT, question=question))


def concept_prompt(text: Column) -> Column:
    """What asks for the concept of a text (STR-16)."""
    return filled(CONCEPT_PROMPT, text=text)


def rule_branch(path: Column) -> Column:
    """The first rule of an assignment's path (STR-17)."""
    return F.split_part(path, F.lit("+"), F.lit(1))


def flat_answers(answers: Column) -> Column:
    """Stripped answers, not empty, each once, as they come (STR-18)."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), scalar.strip), lambda a: a != ""))


def instance_features(rows: DataFrame, instance: list[str], change: str, n_changed: str, mention: str, order: str = "_ord") -> DataFrame:
    """Per instance its perturbations, mean and largest change, mean number of changed tokens, and the first mention's length (AGG-14)."""
    return rows.groupBy(*instance).agg(
        F.count("*").alias("n_accepted_perts"), F.avg(change).alias("mean_change"), F.max(change).alias("max_change"), F.avg(n_changed).alias("mean_changed_tokens_n"),
        F.char_length(scalar.strip(F.min_by(mention, order))).alias("mention_char_len"),
    )


def type_diagnostics(rows: DataFrame, kind: str, accepted: str, change: str) -> DataFrame:
    """Per type its rows, accepted ones, mean and median change, and the rate of failure (AGG-18)."""
    ok = F.col(accepted).cast("int")
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(ok).alias("n_accepted"), F.avg(change).alias("mean_change"), F.median(change).alias("median_change"), (1 - F.avg(ok)).alias("fail_rate"))


def column_mode(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """The commonest value, the smallest of equals; N/A of none (AGG-25)."""
    n = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    # of a value a row: ties by the smallest
    top = n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_b"))
    if not by:
        return top.select(F.coalesce(F.col("_b.v").cast("string"), F.lit("N/A")).alias("mode"))
    return rows.select(*by).distinct().join(top, by, "left").select(*by, F.coalesce(F.col("_b.v").cast("string"), F.lit("N/A")).alias("mode"))


def scope_values(rows: DataFrame, column: str) -> DataFrame:
    """One value of a scope each: the sum of whole numbers, the mean of numbers, the number of rows (AGG-23). Other cells count as 0,
    are left out, and count."""
    number = F.expr(f"try_cast(`{column}` as double)")
    made = rows.agg(F.sum(F.coalesce(number, F.lit(0.0)).cast("long")).alias("sum_int"), F.avg(number).alias("mean"), F.count("*").alias("rows"))
    return made.select(F.explode(F.array(*[F.struct(F.lit(n).alias("agg"), F.col(n).cast("double").alias("value")) for n in ("sum_int", "mean", "rows")])).alias("v")).select("v.*")


def selected(rows: DataFrame, pins: dict[str, object], identity: list[str], order: list[str] | None = None, rank: int | None = None) -> DataFrame:
    """The one row that the pins name; or with ``rank`` the n-th of those, by ``order`` (RCP-12, WIN-11).

    Being the only match is not being the one meant: each column of ``identity`` must be pinned, but those that the rank orders by.
    """
    free = [c for c in identity if c not in pins and not (rank is not None and c in (order or []))]
    if free:
        raise ReceiptError(f"not pinned: {free}")
    for column, value in pins.items():
        rows = rows.where(F.col(column).cast("string") == F.lit(str(value)))
    if rank is not None:
        return rows.orderBy(*order).offset(rank - 1).limit(1)
    if (n := rows.limit(2).count()) != 1:
        raise ReceiptError(f"{'no row' if not n else 'several rows'}, need exactly 1")
    return rows


def in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows by a list of categories, others after them by name (SRT-05)."""
    return rows.orderBy(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)), F.lit(len(order) + 1)), column)


def negative_controls(entropy: DataFrame, model: str, value: str, most: float = 0.05) -> DataFrame:
    """Per model the mean entropy over identical copies of its inputs, which must be 0; beyond ``most`` it is excluded (STA-26)."""
    return entropy.groupBy(model).agg(F.avg(value).alias("mean_identical")).withColumn("excluded", F.coalesce(F.col("mean_identical") > most, F.lit(False)))


def quartiles(rows: DataFrame, by: list[str], accuracy: str, entropy: str, *more: str) -> DataFrame:
    """Rows of the best and the worst quarter by accuracy, limits included, with ``side``; a row may be of both (STA-30)."""
    used, _ = kept(rows.where(F.col(accuracy).isNotNull() & F.col(entropy).isNotNull()).select(*dict.fromkeys([*by, accuracy, entropy, *more])))
    edges, _ = kept(quantiles(used, by, accuracy, [0.25, 0.75]).select(*[F.col(c).alias(f"_of_{c}") for c in by], "q"))
    joined = used.join(F.broadcast(edges) if edges.limit(100_001).count() <= 100_000 else edges, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or F.lit(True))
    sides = F.filter(F.array(F.when(F.col(accuracy) >= F.col("q")[1], "top"), F.when(F.col(accuracy) <= F.col("q")[0], "bottom")), lambda x: x.isNotNull())
    return joined.withColumn("side", F.explode(sides)).drop("q", *[f"_of_{c}" for c in by])


def quartile_contrast(rows: DataFrame, by: list[str], accuracy: str, entropy: str) -> DataFrame:
    """Mean entropy of the best and the worst quarter by accuracy, limits included, and their difference (STA-30)."""
    top, low = F.col("side") == "top", F.col("side") == "bottom"
    made = quartiles(rows, by, accuracy, entropy).groupBy(*by).agg(F.count_if(top).alias("n_top"), F.count_if(low).alias("n_bottom"), F.avg(F.when(top, F.col(entropy))).alias("mean_top"), F.avg(F.when(low, F.col(entropy))).alias("mean_bottom"))
    return made.withColumn("difference", F.col("mean_top") - F.col("mean_bottom"))


def quartile_pairs(rows: DataFrame, by: list[str], accuracy: str, entropy: str, key: str, seed: str = "42") -> DataFrame:
    """(by, d): differences of entropy, best quarter less worst, of arbitrary pairs (STA-30). Either side comes in the order of a hash of
    its key, so the larger side is a sample without replacement of the smaller one's size, and both may be of any size."""
    from .running import running

    sided = quartiles(rows, by, accuracy, entropy, key).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "side")))
    placed = running(sided, [*by, "side"], [F.col("_h").asc(), F.col(key).asc()], {"_k": F.lit(1)})
    side = lambda name: placed.where(F.col("side") == name).select(*[F.col(c).alias(f"_{name}_{c}") for c in by], F.col("_k").alias(f"_{name}_k"), F.col(entropy).alias(f"_{name}_e"))
    top, low = side("top"), side("bottom")
    same = [F.col(f"_top_{c}").eqNullSafe(F.col(f"_bottom_{c}")) for c in by] + [F.col("_top_k") == F.col("_bottom_k")]
    return top.join(low, same).select(*[F.col(f"_top_{c}").alias(c) for c in by], (F.col("_top_e") - F.col("_bottom_e")).alias("d"))


def group_figures(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(group_type, group_name, n, mean, median, sd, min, max, nonzero_count, nonzero_rate, pct_zero, pct_above) of a value by each key
    alone (AGG-22, AGG-26). sd is 0 of one row; a value of up to 1e-12 is zero, above counts those over 0.20. Groups of any size."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("group_type"), F.col(k).cast("string").alias("group_name")) for k in keys]))
    each, _ = kept(rows.where(F.col(value).isNotNull()).select(pairs.alias("_g"), F.col(value).cast("double").alias("_v")).select("_g.*", "_v"))
    v, by = F.col("_v"), ["group_type", "group_name"]
    made = each.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v > 0).alias("nonzero_count"), F.avg((v > 0).cast("int")).alias("nonzero_rate"), (100 * F.avg((v <= 1e-12).cast("int"))).alias("pct_zero"), (100 * F.avg((v > 0.20).cast("int"))).alias("pct_above"),
    )
    medians = quantiles(each, by, "_v", [0.5]).select(F.col("group_type").alias("_t"), F.col("group_name").alias("_n"), F.col("q")[0].alias("median"))
    joined = made.join(medians, F.col("group_type").eqNullSafe(F.col("_t")) & F.col("group_name").eqNullSafe(F.col("_n")))
    return joined.select(*by, "n", "mean", "median", "sd", "min", "max", "nonzero_count", "nonzero_rate", "pct_zero", "pct_above")


def bimodality(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, pct_zero, pct_middle, pct_above, persists): a spike at zero of 40 % or more, a tail above 0.20 of 15 % or more, and less
    between 0.05 and 0.20 than in the tail (AGG-22)."""
    v = F.col(value)
    share = lambda c: 100 * F.avg(c.cast("int"))
    made = rows.where(v.isNotNull()).groupBy(*by).agg(share(v <= 1e-12).alias("pct_zero"), share((v > 0.05) & (v <= 0.20)).alias("pct_middle"), share(v > 0.20).alias("pct_above"))
    return made.withColumn("persists", (F.col("pct_zero") >= 40) & (F.col("pct_above") >= 15) & (F.col("pct_middle") < F.col("pct_above")))


def exact_matches(queries: DataFrame, forms: DataFrame, text: str = "text") -> DataFrame:
    """(qid, cui) of concepts that have a query's text as a form, but for case and outer blanks (JOI-10). Blank texts match none."""
    key = lambda c: scalar.casefold(scalar.strip(F.col(c)))
    left = queries.where(~scalar.is_blank(F.col(text))).select("qid", key(text).alias("_k"))
    return left.join(forms.select(key("form").alias("_k"), "cui").distinct(), "_k").select("qid", "cui").distinct()


def rescored(found: DataFrame, queries: DataFrame, forms: DataFrame, least: int = 3) -> DataFrame:
    """Retrieved (query_id, form_id) with the product of their vectors, without forms of fewer than ``least`` characters (VEC-06)."""
    from .retrieval import dot

    long = forms.where(F.char_length("form") >= least).select("form_id", F.col("vector").alias("_f"))
    return found.select("query_id", "form_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(long, "form_id").select("query_id", "form_id", dot(F.col("_q"), F.col("_f")).alias("score"))


def preferred(names: DataFrame, kinds: tuple[str, ...] = ("PT", "PN")) -> DataFrame:
    """(form, cui) of preferred names alone, in usable forms (VEC-08)."""
    from .retrieval import usable_forms

    return usable_forms(names.where(F.col("tty").isin(*kinds)).select("form", "cui")).distinct()


def file_times(files: DataFrame) -> DataFrame:
    """(path, modified) of the files that were read, in UTC (DAT-01)."""
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def nth(rows: DataFrame, by: list[str], order: list[str], rank: int) -> DataFrame:
    """The n-th row of each group (WIN-11)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") == rank).drop("_k")
