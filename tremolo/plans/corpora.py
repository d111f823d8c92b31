"""Queries through files that they write first: annotated corpora, archives of questions, frozen inputs, and the sinks' other forms."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts, receipts
from ..sources import annotated, readers, sinks
from . import standins as s
from .registry import query

#: Names a document.
DOC_NAMES = 64

ANNOTATED = f"""cu as (select c_custkey, c_custkey // {DOC_NAMES} as d, c_name, c_nationkey, sum(length(c_name) + 1) over (partition by c_custkey // {DOC_NAMES} order by c_custkey rows unbounded preceding) - length(c_name) - 1 as pos from customer)"""


def annotated_corpus(spark: SparkSession, sf_dir: str) -> str:
    """A folder of documents of customers' names, each with its .ann; every fifth document lacks its text. Files are written whole, so
    a task that runs again writes the same."""
    where = cuts.folder(spark, "standoff")
    rows = s.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.floor(F.col("c_custkey") / DOC_NAMES).alias("d"))

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        system, folder = cuts.file_system(where)
        system.create_dir(folder, recursive=True)
        at, lines = 0, []
        for k, name, nation in group.sort_values("c_custkey")[["c_custkey", "c_name", "c_nationkey"]].itertuples(index=False):
            span, code = f"{at} {at + len(name)}", 100_000 + int(nation)
            head = f"CONCEPT_LESS {span}" if k % 7 == 0 else f"{code} {at} {at + 3};{at + 4} {at + len(name)}" if k % 11 == 0 else f"{code} or {code + 1} {span}" if k % 13 == 0 else "broken" if k % 17 == 0 else f"{code} {span}"
            lines.append(f"T{k}\t{head}\t{name}")
            at += len(name) + 1
        files = {"ann": "\n".join([*lines, "R1\tnot text-bound"])} | ({"txt": " ".join(group.sort_values("c_custkey")["c_name"])} if key[0] % 5 else {})
        for ending, body in files.items():
            with system.open_output_stream(f"{folder}/doc{int(key[0])}.{ending}") as f:
                f.write(body.encode())
        return pd.DataFrame({"n": [len(lines)]})

    rows.groupBy("d").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return where


@query("standoff_documents", f"""with {ANNOTATED}, a as (select *, case when c_custkey % 7 = 0 then 'concept_less' when c_custkey % 11 = 0 then 'discontinuous' when c_custkey % 13 = 0 then 'multi_code' when c_custkey % 17 = 0 then 'malformed' else 'ok' end as status from cu)
select 'doc' || d as doc_id, 'T' || c_custkey as ann_id, status, case when status <> 'malformed' then pos::int end as start, case when status <> 'malformed' then (pos + length(c_name))::int end as "end", c_name as mention, status <> 'malformed' and d % 5 <> 0 as in_text,
  (case when d % 5 <> 0 then sum(length(c_name) + 1) over (partition by d) - 1 else 0 end)::int as text_chars from a""")
def standoff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08: annotations joined with their texts by the reader; a document without one has the empty text."""
    annotated.register(spark)
    rows = spark.read.format("standoff_documents").load(annotated_corpus(spark, sf_dir))
    return rows.select("doc_id", "ann_id", "status", "start", "end", "mention", "in_text", F.char_length("text").alias("text_chars"))


@query("standoff_lines", f"""with {ANNOTATED} select 'doc' || d as doc_id, 'T' || c_custkey as ann_id, case when c_custkey % 7 = 0 then '' when c_custkey % 13 = 0 and c_custkey % 11 <> 0 then (100000 + c_nationkey) || ',' || (100001 + c_nationkey) when c_custkey % 17 = 0 and c_custkey % 11 <> 0 then '' else (100000 + c_nationkey)::varchar end as codes from cu""")
def standoff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07 by the line reader, which reads the same folder as text: documents, annotations, codes."""
    rows = readers.standoff(spark, f"{annotated_corpus(spark, sf_dir)}/*.ann")
    return rows.select("doc_id", "ann_id", F.array_join("codes", ",").alias("codes"))


@query("document_texts", f"""with {ANNOTATED} select 'doc' || d as doc_id, string_agg(c_name, ' ' order by c_custkey) as text from cu where d % 5 <> 0 group by 1""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: a row a text file."""
    return readers.texts(spark, f"{annotated_corpus(spark, sf_dir)}/*.txt")


@query("pubtator_blocks", "select c_custkey::varchar as pmid, c_name || ' of ' || c_mktsegment as text, 0 as start, length(c_name)::int as \"end\", c_name as mention, 'T1' as types, 'C' || c_nationkey as cui from customer union all select c_custkey::varchar, c_name || ' of ' || c_mktsegment, null, null, c_mktsegment, 'T2', 'C99' from customer where c_custkey % 2 = 0")
def pubtator_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05 by the data source, files in ranges of a few blocks; every second block has an annotation without places."""
    annotated.register(spark)
    c, pmid = s.table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    first = F.concat_ws("\t", pmid, F.lit("0"), F.char_length("c_name").cast("string"), "c_name", F.lit("T1"), F.concat(F.lit("UMLS:C"), F.col("c_nationkey").cast("string")))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n"), F.concat_ws("\t", pmid, F.lit("x"), F.lit(""), "c_mktsegment", F.lit("T2"), F.lit("C99")))).otherwise("")
    where = cuts.folder(spark, "pubtator")
    c.select(F.concat(pmid, F.lit("|t|"), "c_name", F.lit("\n"), pmid, F.lit("|a|of "), "c_mktsegment", F.lit("\n"), first, second, F.lit("\n"))).write.text(where)
    return spark.read.format("pubtator_blocks").option("rangeBytes", 20_000).load(where)


#: Questions an archive, in two members.
ZIP_QUESTIONS = 500


@query("zipped_questions", f"""select 'part' || (p_partkey // {ZIP_QUESTIONS}) || '.zip' as archive, 'set/m' || (p_partkey % 2) || '.json' as member, p_partkey::varchar as id, p_name as body, case p_partkey % 3 when 0 then p_brand when 1 then p_brand || '|' || p_type else p_brand end as answers from part where p_partkey % 4 <> 0""")
def zipped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: questions of one type from archives of two members each, a task a member."""
    annotated.register(spark)
    where = cuts.folder(spark, "questions")
    rows = s.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.floor(F.col("p_partkey") / ZIP_QUESTIONS).alias("z"))

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        system, folder = cuts.file_system(where)
        system.create_dir(folder, recursive=True)
        members: dict[int, list[dict]] = {0: [], 1: []}
        for k, name, brand, kind in group[["p_partkey", "p_name", "p_brand", "p_type"]].itertuples(index=False):
            exact = brand if k % 3 == 0 else [brand, kind] if k % 3 == 1 else [[brand, brand], [brand]]
            members[k % 2].append({"id": str(k), "body": name, "type": "factoid" if k % 4 else "list", "exact_answer": exact})
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for m, questions in members.items():
                archive.writestr(f"set/m{m}.json", json.dumps({"questions": questions}))
            archive.writestr("readme.txt", "none")
        with system.open_output_stream(f"{folder}/part{int(key[0])}.zip") as f:
            f.write(data.getvalue())
        return pd.DataFrame({"n": [len(group)]})

    rows.groupBy("z").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    found = spark.read.format("zipped_questions").option("member", r"^set/.*\.json$").load(where).where("type = 'factoid'")
    return found.select("archive", "member", "id", "body", F.array_join("answers", "|").alias("answers"))


@query("frozen_inputs", "select case when n_nationkey % 7 = 3 and n_nationkey % 5 <> 0 then 'gone' when n_nationkey % 5 = 0 then 'changed' else 'same' end as status, count(*) as n from nation where n_nationkey in (select s_nationkey from supplier) group by 1 union all select 'new', 1")
def frozen_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-08, MTH-02: files hashed as streams, held against a stored manifest."""
    rows = s.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name").alias("line"))
    before, after, manifest = (cuts.folder(spark, f"frozen-{k}") for k in ("before", "after", "manifest"))
    put = lambda df, where: df.repartition("n").sortWithinPartitions("n", "line").write.partitionBy("n").text(where)
    put(rows, before)
    n = F.col("n")
    later = rows.where((n % 5 == 0) | (n % 7 != 3)).withColumn("line", F.when(n % 5 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    put(later.unionByName(rows.limit(1).select(F.lit(99).alias("n"), "line")), after)
    # a file of a nation: its folder names it
    named = lambda where: sinks.relative(sinks.file_hashes(spark, where), where).withColumn("path", F.split_part("path", F.lit("/"), F.lit(1))).where("path like 'n=%'")
    sinks.write_new(named(before), manifest)
    return sinks.frozen_changes(spark.read.parquet(manifest), named(after)).groupBy("status").agg(F.count("*").alias("n"))


@query("discovered_files", """with f as (select n_nationkey, lower(n_name) || ['_corpus_pubtator.txt.gz', '_PubTator.tsv', '.txt', '.csv', '_st21pv.gz'][n_nationkey % 5 + 1] as name from nation) select name, case when lower(name) like '%.txt' then 1 else 0 end + case when contains(lower(name), 'pubtator') then 4 else 0 end + case when contains(lower(name), 'corpus') then 2 else 0 end + case when contains(lower(name), 'st21pv') then 2 else 0 end as score from f where not name like '%.csv' and not name like '%_PubTator.tsv'""")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: likely files by their names; a pattern counts in its own case."""
    where = cuts.folder(spark, "found")
    endings = ["_corpus_pubtator.txt.gz", "_PubTator.tsv", ".txt", ".csv", "_st21pv.gz"]

    def write(batches):
        for batch in batches:
            system, folder = cuts.file_system(where)
            system.create_dir(folder, recursive=True)
            for key, name in batch.itertuples(index=False):
                with system.open_output_stream(f"{folder}/{name.lower()}{endings[key % 5]}", compression=None) as f:
                    f.write(b"x")
            yield pd.DataFrame({"n": [len(batch)]})

    s.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return readers.discover(spark, where).select(F.element_at(F.split("path", "/"), -1).alias("name"), "score")


@query("csv_header", "select (row_number() over () - 1)::int as place, column_name as name from (describe select p_partkey, p_name, p_brand from part)")
def csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: the columns of a table of files, from first lines alone."""
    where = cuts.folder(spark, "header")
    sinks.write_csv(s.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), where)
    return spark.createDataFrame(list(enumerate(readers.header(spark, where))), "place int, name string")


@query("quoted_answers", "select p_partkey as id, p_name || '|' || case when p_partkey % 2 = 0 then 'it''s ' || p_brand else p_brand end as answers from part")
def quoted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: printed dicts of arrays in cells, with apostrophes within double quotes."""
    second = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"it\'s '), "p_brand", F.lit('"'))).otherwise(F.concat(F.lit("'"), "p_brand", F.lit("'")))
    cell = F.concat(F.lit("{'text': array(['"), "p_name", F.lit("', "), second, F.lit("], dtype=object), 'answer_start': array([1, 2])}"))
    rows = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cell.alias("c"))
    return rows.select("id", F.array_join(F.filter(readers.quoted_answers("c"), lambda x: x != "object"), "|").alias("answers"))


@query("candidate_labels", "select p_partkey as id, 'C' || p_size as cui, p_name as name from part")
def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16."""
    label = F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise("UMLS:"), F.lit("C"), F.col("p_size").cast("string"), F.lit("||"), "p_name")
    return readers.candidate_labels(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("l")), "l").drop("l")


@query("cached_table", "select p_brand, count(*) as n from part group by 1")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: made once; asked for again, it is read and what would make it isn't run."""
    where = cuts.folder(spark, "cache")
    readers.cached(spark, where, lambda: s.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")))
    return readers.cached(spark, where, lambda: spark.range(0).selectExpr("'none' as p_brand", "id as n"))


@query("refused_overwrite", "select count(*) as n_rows, true as refused from supplier")
def refused_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: a second write to a folder is refused, and the first stays."""
    where, rows = cuts.folder(spark, "new"), s.table(spark, sf_dir, "supplier")
    sinks.write_new(rows, where)
    try:
        sinks.write_new(rows.limit(0), where)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(where).agg(F.count("*").alias("n_rows")).withColumn("refused", F.lit(refused))


@query("run_receipt", "select c_mktsegment as kind, count(*) as n from customer group by 1 union all select 'seed', 42")
def run_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SNK-09: counts by kind and the seed in a JSON file put in place of an older one, read back."""
    where = f"{cuts.folder(spark, 'receipt')}.json"
    n = {r["c_mktsegment"]: r["count"] for r in s.table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().collect()}
    sinks.write_receipt(spark, where, {"seed": 0})
    sinks.write_receipt(spark, where, {"seed": 42, "counts": n})
    held = spark.read.option("multiLine", True).schema("seed long, counts map<string, long>").json(where)
    return held.select(F.explode("counts").alias("kind", "n")).unionByName(held.select(F.lit("seed").alias("kind"), F.col("seed").alias("n")))


@query("markdown_table", "with t as (select n_name as a, n_regionkey::varchar as b from nation), w as (select greatest(max(length(a)), 6) as x, greatest(max(length(b)), 6) as y from t), l as (select 1 as o, '| ' || rpad('nation', x::int, ' ') || ' | ' || rpad('region', y::int, ' ') || ' |' as line from w union all select 2, '|' || repeat('-', x::int + 2) || '|' || repeat('-', y::int + 2) || '|' from w union all select 2 + row_number() over (order by a), '| ' || rpad(a, x::int, ' ') || ' | ' || rpad(b, y::int, ' ') || ' |' from t, w) select (o - 1)::int as place, line from l")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06."""
    rows = s.table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region")).orderBy("nation")
    return spark.createDataFrame(list(enumerate(sinks.markdown(rows).split("\n"))), "place int, line string")


@query("redacted_table", "select doc_id, lang, n_chars from documents")
def redacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: no text, every row."""
    return sinks.redacted(s.table(spark, sf_dir, "documents"), ["text", "source"])


@query("row_receipt", "select count(*) as n_written, true as holds, true as told from lineitem")
def row_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-01: rows counted as they are written; a wrong expectation is an error."""
    rows = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    watched, seen = receipts.counted(rows, "written")
    sinks.write_new(watched, where := cuts.folder(spark, "counted"))
    n = spark.read.parquet(where).count()
    receipts.assert_rows(seen, n)
    try:
        receipts.assert_rows(seen, n + 1)
        told = False
    except receipts.ReceiptError:
        told = True
    return spark.createDataFrame([(n, True, told)], "n_written long, holds boolean, told boolean")


@query("total_lookup", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def total_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-11: every order finds its customer, or the query fails."""
    names = s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return receipts.join_total(s.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, ["o_custkey"], "c_name").drop("o_custkey")
