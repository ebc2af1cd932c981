"""Sources and sinks (S-01 to S-32): lexicons, ground truth, corpora, annotation exports, reports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.sources.scratch import saved

LEXICON = "language biased neutral_primary neutral_alternatives tags pos scope register severity bias_label stereotype_category explicitness ngeli number requires_agreement agreement_notes patterns constraints avoid_when example_biased example_neutral".split()
LEXICON_DEFAULTS = {"severity": "replace", "pos": "noun", "bias_label": "stereotype", "stereotype_category": "profession", "explicitness": "explicit", "register": "formal", "requires_agreement": "false"}
TEXT_COLUMNS = ("text", "sentence", "translation", "utterance", "content")
NULLS = ("", "NEEDS_ANNOTATION", "N/A", "NONE")


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(file, block, n, value) of every line, besides columns that folders name: block and n put a file's lines in order.

    Spark splits large files; a block is what one task read of a file.
    """
    rows = spark.read.text(path, lineSep=line_sep) if line_sep else spark.read.text(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def running(lines: DataFrame, step: Column, name: str, across: bool = False) -> DataFrame:
    """``lines`` with the sum of ``step`` over the lines before each in its file, or ``across`` all files by name.

    Blocks add up by themselves; only their totals, a row a block, are added up in order.
    """
    own = W.partitionBy("file", "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    before = (W.orderBy("file", "block") if across else W.partitionBy("file").orderBy("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = lines.groupBy("file", "block").agg(F.sum(step).alias("_total")).select("file", "block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    summed = lines.withColumn(name, F.coalesce(F.sum(step).over(own), F.lit(0))).join(totals, ["file", "block"])
    return summed.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")


def read_csv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Files with a header, all columns as strings, in file order; cells may hold line ends, and large files are split all the same.

    A record begins where an even number of quotes stands before a line in its file, as quotes within cells are doubled.
    """
    lines = read_lines(spark, path, "\n")
    folders = [c for c in lines.columns if c not in ("value", "file", "block", "n")]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    begun = running(lines, quotes, "_quotes").withColumn("_begins", (F.col("_quotes") % 2 == 0).cast("int"))
    placed = running(begun, F.col("_begins"), "_begun").withColumn("record", F.col("_begun") + F.col("_begins"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"])
    records = placed.groupBy("file", "record", *folders).agg(F.regexp_replace(F.array_join(parts, "\n"), r"\r\z", "").alias("value"))
    header = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).drop(*folders).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in header)
    cells = F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"', "mode": mode, "lineSep": "\n"})
    kept = records.where("record > 1 and value <> ''").orderBy("file", "record")
    return kept.select(cells.alias("_cells"), *folders).select("_cells.*", *folders)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, records) of every CSV file, besides columns that folders name: the names in its first line, and its records.

    Cells may hold line ends: a line counts where an even number of quotes stands before it.
    """
    lines = read_lines(spark, path, "\n")
    folders = [c for c in lines.columns if c not in ("value", "file", "block", "n")]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    begun = running(lines, quotes, "_quotes").where((F.col("_quotes") % 2 == 0) & (F.col("value") != ""))
    found = begun.groupBy("file", *folders).agg(F.min_by("value", F.struct("block", "n")).alias("first"), (F.count(F.lit(1)) - 1).alias("records"))
    names = F.transform(F.split(F.regexp_replace("first", r"\r\z", ""), ","), lambda c: F.btrim(c, F.lit('"')))
    return found.select("file", *folders, names.alias("header"), "records")


def runs_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value, blank) of lines in order as (file, block, k, edge, lines): runs between blank lines, k of them before it.

    ``edge`` marks runs that other blocks may go on with: 0 what stands before a block's first blank line, 1 what stands
    after its last, 0 also all of a block without one. Both come for every block, also where they are empty.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("edge", pa.int32()), ("lines", pa.list_(pa.string()))])
    at, k, kept = None, 0, []

    def rows(file: str, block: int, ks: list, edges: list, lines: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(ks), pa.string()), pa.array([block] * len(ks), pa.int64()), pa.array(ks, pa.int64()), pa.array(edges, pa.int32()), lines], schema=schema)

    def run(edge: int | None) -> pa.RecordBatch:
        values = pa.concat_arrays(kept) if kept else pa.array([], pa.string())
        return rows(*at, [k], [edge], pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))

    for batch in batches:
        files, blocks, values = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        codes = pc.dictionary_encode(files).indices.to_numpy()
        blank = batch.column(3).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if start == stop:
                continue
            here = (files[int(start)].as_py(), int(blocks[start]))
            if here != at:
                if at is not None:
                    yield run(1 if k else 0)
                at, k, kept = here, 0, []
            ends = np.flatnonzero(blank[start:stop]) + start
            if not len(ends):
                kept.append(values.slice(start, stop - start))
                continue
            kept.append(values.slice(start, ends[0] - start))
            yield run(None if k else 0)
            # runs between two blank lines of the batch, the empty ones left out
            begins, lengths = ends[:-1] + 1, np.diff(ends) - 1
            full = np.flatnonzero(lengths > 0)
            if len(full):
                inner = values.slice(int(ends[0]), int(ends[-1] - ends[0])).filter(pa.array(~blank[ends[0] : ends[-1]]))
                offsets = np.concatenate([[0], np.cumsum(lengths[full])]).astype(np.int32)
                yield rows(*at, (full + k + 1).tolist(), [None] * len(full), pa.ListArray.from_arrays(pa.array(offsets), inner))
            k += len(ends)
            kept = [values.slice(int(ends[-1]) + 1, int(stop - ends[-1]) - 1)]
    if at is not None:
        yield run(1 if k else 0)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, lines) of tagged files: any blank line ends a sentence, whatever the line ends are.

    ``sentence`` puts a file's sentences in order. Lines stay in the task that reads them, and are saved as the runs between
    blank lines; only what stands at a block's edges, which sentences may cross, is shuffled.
    """
    lines = read_lines(spark, path)
    # patterns only where a line ends in what they take for a line's end; to trim is the same elsewhere
    value, ends = F.btrim("value", F.lit(" \t\n\x0b\f\r")), ("\x85", "\u2028", "\u2029")
    odd = F.substring(value, -1, 1).isin(*ends)
    trimmed = F.when(odd, F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).otherwise(value)
    runs = lines.select("file", "block", trimmed.alias("value"), F.when(odd, F.col("value").rlike(r"^\s*$")).otherwise(value == "").alias("blank"))
    runs = saved(runs.mapInArrow(runs_of_lines, "file string, block long, k long, edge int, lines array<string>"))
    # a block's lines begin after its start, so that its runs are fewer than its bytes
    numbered = runs.withColumn("sentence", F.col("block") + F.col("k"))
    inner = numbered.where("edge is null")
    before = W.partitionBy("file").orderBy("block", "edge")
    edges = numbered.where("edge is not null").withColumn("group", F.sum("edge").over(before))
    part = F.struct("block", "edge", "sentence", "lines")
    parts = F.filter(F.array_sort(F.collect_list(part)), lambda x: F.size(x["lines"]) > 0)
    whole = edges.groupBy("file", "group").agg(parts.alias("parts")).where(F.size("parts") > 0)
    crossed = whole.select("file", F.get("parts", F.lit(0))["sentence"].alias("sentence"), F.flatten(F.transform("parts", lambda x: x["lines"])).alias("lines"))
    return inner.where(F.size("lines") > 0).select("file", "sentence", "lines").unionByName(crossed)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """S-01: all columns as strings, nulls as empty strings, with the rule's number in file order."""
    schema = ", ".join(f"`{c}` string" for c in LEXICON)
    rows = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', enforceSchema=False).na.fill("")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return running(placed, F.lit(1), "rule_no", across=True).drop("file", "block", "n")


def read_typed_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """S-02: rows with a term; defaults for absent columns only; tags and avoid_when as arrays."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"').na.fill("")
    rows = rows.select("*", *[F.lit(v).alias(c) for c, v in LEXICON_DEFAULTS.items() if c not in rows.columns])
    parts = lambda c: F.filter(F.transform(F.split(F.col(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where(F.trim("biased") != "").withColumns({c: parts(c) for c in ("tags", "avoid_when") if c in rows.columns})


def versioned_name(base: str, language: str, versions: Mapping[str, str]) -> list[str]:
    """S-03: the file of a language's version, then the name without version."""
    return [f"{base}_{language}_{versions[language]}.csv", f"{base}_{language}.csv"] if language in versions else [f"{base}_{language}.csv"]


def read_versioned(spark: SparkSession, folder: str, base: str, language: str, versions: Mapping[str, str]) -> DataFrame:
    """S-03: the first of a language's files that there is."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    names = [f"{folder}/{n}" for n in versioned_name(base, language, versions)]
    found = [n for n in names if jvm.Path(n).getFileSystem(conf).exists(jvm.Path(n))]
    if not found:
        raise FileNotFoundError(f"none of {names}")
    return read_typed_lexicon(spark, found[0])


def enum_value(c, allowed: Sequence[str]):
    """A known value with _ and - alike, or null (also for the words that stand for nothing)."""
    folded = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(x) for v in allowed for x in (v.replace("_", "-"), v)])
    return F.when(~F.upper(F.trim(c)).isin(*NULLS), F.try_element_at(known, folded))


def read_truth(spark: SparkSession, path: str, categories: Sequence[str], enums: Mapping[str, Sequence[str]] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """S-04, S-05: ground truth, legacy or extended (it has target_gender or bias_label); enums checked, numbers tried."""
    rows = read_csv(spark, path, mode)
    category = F.lower(F.trim(F.coalesce("bias_category", F.lit(""))))
    out = {"text": F.btrim("text", F.lit('"')), "has_bias": F.lower(F.trim("has_bias")) == "true", "bias_category": F.when(category == "", "none").when(category.isin(*categories), category).otherwise("stereotype")}
    if {"target_gender", "bias_label"} & set(rows.columns):
        out |= {c: enum_value(F.col(c), v) for c, v in (enums or {}).items() if c in rows.columns}
        out |= {c: F.try_to_number(F.col(c), F.lit("999999")).cast("int") for c in ("bias_severity",) if c in rows.columns}
        out |= {c: F.expr(f"try_cast(`{c}` as double)") for c in ("cohen_kappa",) if c in rows.columns}
        out |= {c: F.lower(F.trim(c)).isin("true", "1", "yes") for c in ("pii_removed",) if c in rows.columns}
    return rows.withColumns(out)


def read_log(spark: SparkSession, path: str, schema: str, ts: str = "timestamp") -> DataFrame:
    """S-06: JSON lines, newest first; lines that don't parse are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").orderBy(F.desc(ts))


def read_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S-07 to S-10, S-15: json, csv, conll or plain files as one column of texts."""
    if kind == "plain":
        return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")
    if kind == "conll":
        first = F.transform("lines", lambda x: F.get(F.split(x, r"\s+"), F.lit(0)))
        return read_sentences(spark, path).select(F.array_join(first, " ").alias("text"))
    rows = spark.read.json(path, multiLine=kind == "json") if kind in ("json", "jsonl") else read_csv(spark, path, "PERMISSIVE")
    own = [c for c in TEXT_COLUMNS if c in rows.columns] or rows.columns[:1]
    return rows.select(F.coalesce(*[F.col(c) for c in own]).alias("text")).where("trim(text) <> ''")


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """S-11: (sentence, pos, token, tag) of lines with exactly two fields; a blank line ends a sentence. ``person``: it has a PER tag."""
    person = F.exists("lines", lambda x: x.rlike(r"^\S+\s+\S*PER\z"))
    rows = read_sentences(spark, path).select(F.concat_ws(":", "file", "sentence").alias("sentence"), person.alias("person"), "lines")
    blocks = rows.select("sentence", "person", F.posexplode("lines").alias("pos", "line"))
    parts = F.split("line", r"\s+")
    return blocks.where(F.size(parts) == 2).select("sentence", "pos", F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).alias("tag"), "person")


def sniffed_formats(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """S-12: json, csv, conll or plain for every file, from its first lines."""
    first = read_lines(spark, path).where("block = 0").select("file", "n", "value")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first lines of each file that a task reads from its beginning on."""
        seen: Counter = Counter()
        for batch in batches:
            kept = []
            for k, file in enumerate(batch.column(0).to_pylist()):
                seen[file] += 1
                if seen[file] <= lines:
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    head = first.mapInArrow(heads, first.schema).withColumn("r", F.row_number().over(W.partitionBy("file").orderBy("n")))
    v = F.trim("value")
    counted = head.groupBy("file").agg(F.count_if(v.rlike(r"^[\[{]")).alias("j"), F.count_if(v.rlike(r"^\S+[ \t]+\S+$")).alias("c"), F.count_if(v != "").alias("n"), F.max(F.when(F.col("r") == 1, v.contains(","))).alias("header"))
    kind = F.when(F.col("j") > 0, "json").when(F.col("header"), "csv").when((F.col("c") >= 0.8 * F.col("n")) & (F.col("n") > 0), "conll").otherwise("plain")
    return counted.select("file", kind.alias("kind"))


def read_tree(spark: SparkSession, path: str, suffix: str = "*.csv") -> DataFrame:
    """S-13: all files below a folder, with their paths."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).csv(path, header=True).withColumn("source_file", F.col("_metadata.file_name"))


def merged_sources(frames: Mapping[str, DataFrame], collected: str, urls: Mapping[str, str] | None = None) -> DataFrame:
    """S-14: many tables as one, with what each came from."""
    out = None
    for name, frame in frames.items():
        own = frame.withColumn("source_file", F.lit(name)).withColumn("source_url", F.lit((urls or {}).get(name))).withColumn("collection_date", F.lit(collected).cast("date"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def read_verses(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """S-16: a verse per line; book and chapter from the file's name (book_chapter.txt), verses count kept lines."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)_?(\d+)\.", 1).alias("book"), F.regexp_extract(F.col("_metadata.file_name"), r"_?(\d+)\.", 1).alias("chapter"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("text"))
    kept = rows.where(F.length("text") >= least)
    return kept.withColumn("verse", F.row_number().over(W.partitionBy("book", "chapter").orderBy("at", "n"))).select("book", "chapter", "verse", "text")


def benchmark_sentences(rows: DataFrame, kind: str) -> DataFrame:
    """S-17: numbered bracketed sentences, sentences with an occupation in the id, or sentence pairs."""
    if kind == "bracketed":
        return rows.select(F.trim(F.regexp_replace(F.regexp_replace("value", r"^\d+\s+", ""), r"[\[\]]", "")).alias("text"))
    if kind == "occupation":
        return rows.select(F.get(F.split("sentid", r"\."), F.lit(0)).alias("occupation"), F.col("sentence").alias("text"))
    pair = F.array(F.struct(F.col("sent_more").alias("text"), F.lit(True).alias("has_bias")), F.struct(F.col("sent_less").alias("text"), F.lit(False).alias("has_bias")))
    return rows.where("bias_type = 'gender'").select(F.explode(pair).alias("p")).select("p.*")


def candidate_sentences(rows: DataFrame, entry: str = "entry", keys: Sequence[str] = ("sentence", "text", "template", "sent"), listed: str = "sentences", least: int = 20) -> DataFrame:
    """S-18: candidate texts of JSON entries of any shape: the named keys and the list, or any longer value that ends like a sentence.

    Only strings count. Entries that don't parse, or aren't objects, give none.
    """
    parsed = F.try_parse_json(F.col(entry))
    strings = lambda xs: F.transform(F.filter(xs, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    cells = rows.select(F.try_variant_get(parsed, "$", "map<string,variant>").alias("cells"))
    named = F.filter(F.array(*[F.try_element_at("cells", F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    several = F.coalesce(F.try_variant_get(F.try_element_at("cells", F.lit(listed)), "$", "array<variant>"), F.array().cast("array<variant>"))
    found = cells.where("cells is not null").select(strings(F.concat(named, several)).alias("named"), strings(F.map_values("cells")).alias("all"))
    other = F.filter("all", lambda x: (F.length(x) > least) & F.trim(x).rlike(r"[.?!]$"))
    return found.select(F.explode(F.when(F.size("named") > 0, F.col("named")).otherwise(other)).alias("text"))


def first_usable(rows: DataFrame, columns: Sequence[str], n: int, least: int = 20) -> DataFrame:
    """S-19, S-30: the first column with a text that is long enough, for the first n non-blank rows."""
    text = F.coalesce(*[F.when(F.length(F.trim(c)) >= least, F.trim(c)) for c in columns])
    return rows.select(text.alias("text")).where("text is not null").limit(n)


def flattened_export(rows: DataFrame) -> DataFrame:
    """S-20: nested tasks (id, annotations of result lists) as a row per annotator with its choices by name."""
    a = rows.select("id", F.explode("annotations").alias("a"))
    values = F.map_from_entries(F.transform("a.result", lambda r: F.struct(r["from_name"], r["value"])))
    return a.select("id", F.col("a.annotator").alias("annotator"), values.alias("choices"))


def batch_rows(batches: DataFrame) -> DataFrame:
    """S-21: annotation batches with nested samples as rows keyed by (batch_id, pos)."""
    return batches.select("batch_id", "language", "annotator_id", F.posexplode("samples").alias("pos", "sample")).select("batch_id", "language", "annotator_id", "pos", "sample.*")


def write_batches(rows: DataFrame, path: str, by: Sequence[str], order: str) -> None:
    """S-21: a JSON line per batch with its samples in order; batches are as small as people can annotate."""
    rest = [c for c in rows.columns if c not in by]
    samples = F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order])))
    rows.groupBy(*by).agg(samples.alias("samples")).write.json(path)


def unannotated(texts: DataFrame, annotator: str, keep: Sequence[str] = ()) -> DataFrame:
    """S-22: texts as samples to be annotated, with the columns to ``keep``."""
    return texts.select(*keep, "text", F.lit(None).cast("boolean").alias("has_bias"), F.lit(annotator).alias("annotator_id"), F.lit("medium").alias("confidence"))


def write_corpus(rows: DataFrame, path: str, source: str, order: Sequence[str]) -> None:
    """S-23: JSON lines with ids source_000001 and on."""
    from lexiscope.operators.datasets import numbered

    ided = numbered(rows, order, name="n").withColumn("id", F.format_string(f"{source}_%06d", "n")).drop("n")
    ided.write.json(path)


def write_table(rows: DataFrame, path: str, columns: Sequence[str] | None = None, kind: str = "csv", by: Sequence[str] = ()) -> None:
    """S-24 to S-27, S-31, S-32: chosen columns as csv, json or parquet, in a folder per value of ``by``."""
    out = rows.select(*columns) if columns else rows
    writer = out.write.partitionBy(*by) if by else out.write
    if kind == "csv":
        writer = writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("header", True).format(kind).save(path)


#: Columns of the full and the core ground truth, and of the list of disagreements (fixed values).
TRUTH_COLUMNS = "text has_bias bias_category expected_correction annotator_id confidence annotation_timestamp notes demographic_group gender_referent protected_attribute fairness_score context_requires_gender severity language_variant ml_prediction ml_confidence human_model_agreement correction_accepted source_dataset source_url collection_date multi_annotator version".split()
CORE_COLUMNS = "text has_bias bias_category expected_correction annotator_id confidence demographic_group gender_referent".split()
DISAGREEMENT_COLUMNS = "text annotator_id has_bias bias_category expected_correction confidence human_model_agreement".split()


def projected(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """S-25, S-31: the columns in order, null where the rows don't have one."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def lineage(rows: DataFrame, source: str, license_name: str) -> DataFrame:
    """S-24: what was collected, as one row."""
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("lang").alias("languages"), F.sum(F.length("text")).cast("long").alias("characters")).withColumn("source", F.lit(source)).withColumn("license", F.lit(license_name))


def annotator_summary(rows: DataFrame, item: str = "doc_id", who: str = "annotator") -> DataFrame:
    """S-32: items, items with two raters at least, and raters, as one row."""
    items = rows.groupBy(item).agg(F.count_distinct(who).alias("raters"))
    return items.agg(F.count(F.lit(1)).alias("tasks_total"), F.count_if(F.col("raters") >= 2).alias("tasks_with_2_annotations")).join(rows.agg(F.array_join(F.array_sort(F.collect_set(who)), ",").alias("annotators")))


def text_report(rows: DataFrame) -> DataFrame:
    """S-27: every cell as a line "column: value"."""
    return rows.select(F.explode(F.array(*[F.concat_ws(": ", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in rows.columns])).alias("value"))


def rule_counts(lexicon: DataFrame) -> DataFrame:
    """S-29: rules of every language."""
    return lexicon.groupBy("language").agg(F.count(F.lit(1)).alias("rules"))


def report_rows(metrics: DataFrame) -> DataFrame:
    """S-26: metrics as text with three digits, OVERALL first."""
    return metrics.select("lang", *[F.format_string("%.3f", F.col(c)).alias(c) for c in ("precision", "recall", "f1")], *[F.col(c).cast("string").alias(c) for c in ("tp", "fp", "fn", "tn")]).orderBy(F.col("lang") != "OVERALL", "lang")


def appended_registry(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """S-28: the entry's rows whose tag the registry doesn't have yet."""
    return entry.join(registry.select("tag").distinct(), "tag", "left_anti")


def latest_report(rows: DataFrame) -> DataFrame:
    """S-29: OVERALL rows of the report with the last file name."""
    last = rows.agg(F.max("source_file").alias("source_file"))
    return rows.join(F.broadcast(last), "source_file", "left_semi").where("lang = 'OVERALL'")
