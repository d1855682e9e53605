"""Entity, truth and match files: reading with checks, writing, and validating."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_id", "matched_entity_ids")
TRUTH_FILE = ("source1_entity_id", "matched_entity_ids")
MATCHES, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


class BadTable(ValueError):
    """A file that isn't the table that it should be."""


def entity_path(folder: str, split: str, source: int) -> str:
    return f"{folder.rstrip('/')}/{split}_source{source}.tsv"


def truth_path(folder: str, split: str = "train") -> str:
    return f"{folder.rstrip('/')}/{split}_ground_truth.tsv"


def check_header(spark: SparkSession, path: str, required: tuple[str, ...]) -> list[str]:
    """The columns of a TSV; raises BadTable if it is missing, empty, a large-file pointer, or lacks columns."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as e:
        raise BadTable(f"{path}: can't be read") from e
    if not first:
        raise BadTable(f"{path}: empty")
    line = first[0][0].lstrip("﻿")
    if line.startswith("version https://git-lfs.github.com/spec/"):
        raise BadTable(f"{path}: a pointer, not the data")
    columns = [c.strip().strip('"') for c in line.split("\t")]
    if missing := [c for c in required if c not in columns]:
        raise BadTable(f"{path}: lacks {', '.join(missing)}")
    return columns


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """The required columns as trimmed strings; missing fields are ''. Quotes may hold tabs, line breaks and doubled quotes."""
    columns = check_header(spark, path, required)
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)
    return rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in required])


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ENTITY)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (source1_id, target_id) of a truth file; ids are split at commas, trimmed, empty ones dropped."""
    rows = read_tsv(spark, path, TRUTH_FILE)
    return truth_pairs(rows.select(F.col(TRUTH_FILE[0]).alias(TRUTH[0]), TRUTH[1]))


def truth_pairs(rows: DataFrame) -> DataFrame:
    pairs = rows.select(F.trim("source1_id").alias("source1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("t"))
    return pairs.select("source1_id", F.trim("t").alias("target_id")).where("target_id <> '' and source1_id <> ''").distinct()


def read_targets(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Both target sources; of a repeated id one row stays, the last by its fields."""
    both = read_entities(spark, entity_path(folder, split, 2)).unionByName(read_entities(spark, entity_path(folder, split, 3)))
    return unique_targets(both)


def unique_targets(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c != "entity_id"]
    return rows.groupBy("entity_id").agg(F.max(F.struct(*fields)).alias("r")).select("entity_id", "r.*")


def require_unique(sources: DataFrame) -> DataFrame:
    """``sources``; raises BadTable if an entity_id repeats."""
    twice = sources.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise BadTable(f"source entity {twice[0][0]} is there twice")
    return sources


def clean_id(c: Column) -> Column:
    """Trimmed id; none and nan are no ids."""
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(v).isin("none", "nan"), F.lit("")).otherwise(v)


def match_rows(sources: DataFrame, candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per source entity, those without any included: candidates by rank, matches by probability and id; comma lists.

    Accepted pairs that aren't candidates raise BadTable."""
    outside = accepted.join(candidates, ["source1_id", "target_id"], "left_anti").limit(1).collect()
    if outside:
        raise BadTable(f"match {outside[0]['source1_id']} - {outside[0]['target_id']} isn't a candidate")
    c = candidates.groupBy("source1_id").agg(F.sort_array(F.collect_list(F.struct("rank", "target_id"))).alias("c"))
    m = accepted.groupBy("source1_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("probability")).alias("p"), "target_id"))).alias("m"))
    rows = sources.select(F.col("entity_id").alias("source1_id")).join(c, "source1_id", "left").join(m, "source1_id", "left")
    listed = lambda x: F.array_join(F.array_distinct(F.coalesce(F.transform(x, lambda s: s["target_id"]), F.array().cast("array<string>"))), ",")
    return rows.select("source1_id", listed("c").alias(CANDIDATES), listed("m").alias(MATCHES))


def rows_by_threshold(sources: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Matches by a threshold, ids ascending."""
    m = scored.where(F.col("probability") >= threshold).groupBy("source1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(MATCHES))
    return sources.select(F.col("entity_id").alias("source1_id")).join(m, "source1_id", "left").select("source1_id", F.coalesce(MATCHES, F.lit("")).alias(MATCHES))


def write_matches(rows: DataFrame, path: str) -> None:
    """A folder of TSV parts, sorted by source entity within and across parts."""
    rows.select(F.col("source1_id").alias("source1_entity_id"), *[c for c in rows.columns if c != "source1_id"]).orderBy("source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def findings(rows: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """kind, source1_id, detail: what is wrong with match rows.

    duplicate_row, repeated_id, self_match, wrong_prefix, unknown_id (with ``targets``), missing_source, extra_source, and
    not_candidate, a warning, where candidate lists are given."""
    ids = F.filter(F.transform(F.split(F.coalesce(F.col(MATCHES), F.lit("")), ","), clean_id), lambda v: v != "")
    rows = rows.withColumn("m", ids)
    s = sources.select(F.col("entity_id").alias("source1_id"))

    def found(kind: str, df: DataFrame, detail: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "source1_id", detail.cast("string").alias("detail"))

    each = rows.select("source1_id", F.explode("m").alias("t"))
    out = found("duplicate_row", rows.groupBy("source1_id").agg(F.count("*").alias("n")).where("n > 1"), F.col("n"))
    out = out.unionByName(found("repeated_id", each.groupBy("source1_id", "t").agg(F.count("*").alias("n")).where("n > 1"), F.col("t")))
    out = out.unionByName(found("self_match", each.where("t = source1_id").distinct(), F.col("t")))
    out = out.unionByName(found("wrong_prefix", each.where(~F.col("t").rlike("^S[23]-")).distinct(), F.col("t")))
    out = out.unionByName(found("missing_source", s.join(rows, "source1_id", "left_anti"), F.lit("")))
    out = out.unionByName(found("extra_source", rows.select("source1_id").distinct().join(s, "source1_id", "left_anti"), F.lit("")))
    if targets is not None:
        out = out.unionByName(found("unknown_id", each.distinct().join(targets.select(F.col("entity_id").alias("t")), "t", "left_anti"), F.col("t")))
    if CANDIDATES in rows.columns:
        c = F.filter(F.transform(F.split(F.coalesce(F.col(CANDIDATES), F.lit("")), ","), clean_id), lambda v: v != "")
        out = out.unionByName(found("not_candidate", rows.select("source1_id", F.explode(F.array_except("m", c)).alias("t")), F.col("t")))
    return out


def write_json(spark: SparkSession, path: str, values: dict) -> None:
    """A report as a folder with one text file, through Spark's file systems."""
    text = json.dumps(values, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def find_dataset(spark: SparkSession, folders: list[str], split: str) -> str:
    """The first folder that has the three entity files of the split (and its truth, for train); BadTable if none has."""
    for folder in folders:
        try:
            for source in (1, 2, 3):
                check_header(spark, entity_path(folder, split, source), ENTITY)
            if split == "train":
                check_header(spark, truth_path(folder, split), TRUTH_FILE)
        except BadTable:
            continue
        return folder.rstrip("/")
    raise BadTable(f"none of {', '.join(folders)} has the files of {split}")


def source_order(spark: SparkSession, path: str) -> DataFrame:
    """source1_id, position: the order of an entity file's rows."""
    return read_tsv(spark, path, ENTITY).select(F.col("entity_id").alias("source1_id"), F.monotonically_increasing_id().alias("position"))


def write_submission(rows: DataFrame, order: DataFrame, path: str) -> None:
    """Two folders of TSV parts, ``path``/candidates and ``path``/matches, a line per source entity in the order of its file.

    Parts in the order of their names make the file; a shuffle by ranges of positions sorts them, so none grows with the whole.
    """
    placed = rows.join(order, "source1_id")
    for name, column in (("candidates", CANDIDATES), ("matches", MATCHES)):
        placed.orderBy("position").select(F.col("source1_id").alias("source1_entity_id"), column).write.mode("overwrite").csv(f"{path.rstrip('/')}/{name}", sep="\t", header=True, emptyValue="", quote="")


def rows_from_pairs(sources: DataFrame, targets: DataFrame, pairs: DataFrame, probabilities: DataFrame, threshold: float) -> DataFrame:
    """Match rows from pairs (pair, source1_id, target_id, rank) and probabilities (pair, probability), joined by the pair's number.

    Raises BadTable if a pair lacks a probability or has several, repeats, or names an entity that isn't there.
    """
    both = pairs.join(probabilities, "pair", "full")
    checks = {
        "pairs without a probability": both.where("probability is null"),
        "probabilities without a pair": both.where("source1_id is null"),
        "pairs that repeat": both.groupBy("source1_id", "target_id").agg(F.count("*").alias("n")).where("n > 1"),
        "unknown source entities": pairs.join(sources.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_anti"),
        "unknown targets": pairs.join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti"),
    }
    for what, rows in checks.items():
        if rows.limit(1).count():
            raise BadTable(what)
    return match_rows(sources, pairs, both.where(F.col("probability") >= threshold))


def contract_findings(candidates: DataFrame, matches: DataFrame, order: DataFrame) -> DataFrame:
    """kind, source1_id: where two submission tables (position, source1_id, list) break the output contract.

    order: the row at a position isn't the source file's; missing, extra, repeated: rows; prefix: a target id that isn't one of
    source 2 or 3; twice: a target listed twice; subset: a match that isn't a candidate; no_candidates: an entity with matches alone.
    """
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), clean_id), lambda v: v != "")
    found = lambda kind, df: df.select(F.lit(kind).alias("kind"), "source1_id")
    out = None
    tables = [(candidates, CANDIDATES), (matches, MATCHES)]
    for rows, column in tables:
        ids = listed(column)
        some = [
            found("order", order.select("position", F.col("source1_id").alias("expected")).join(rows, "position", "full").where("not (expected <=> source1_id)").withColumn("source1_id", F.coalesce("source1_id", "expected"))),
            found("missing", order.join(rows, "source1_id", "left_anti")), found("extra", rows.join(order, "source1_id", "left_anti")),
            found("repeated", rows.groupBy("source1_id").agg(F.count("*").alias("n")).where("n > 1")),
            found("prefix", rows.where(F.exists(ids, lambda v: ~v.rlike("^S[23]-")))), found("twice", rows.where(F.size(ids) > F.size(F.array_distinct(ids)))),
        ]
        for x in some:
            out = x if out is None else out.unionByName(x)
    both = candidates.select("source1_id", listed(CANDIDATES).alias("c")).join(matches.select("source1_id", listed(MATCHES).alias("m")), "source1_id")
    out = out.unionByName(found("subset", both.where(F.size(F.array_except("m", "c")) > 0)))
    return out.unionByName(found("no_candidates", both.where((F.size("c") == 0) & (F.size("m") > 0)))).distinct()


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and matches that ``write_submission`` wrote, with the position of each line."""
    out = []
    for name, column in (("candidates", CANDIDATES), ("matches", MATCHES)):
        rows = read_tsv(spark, f"{path.rstrip('/')}/{name}", (TRUTH_FILE[0], column))
        out.append(rows.select(F.monotonically_increasing_id().alias("position"), F.col(TRUTH_FILE[0]).alias("source1_id"), column))
    return out[0], out[1]


def write_features(rows: DataFrame, names: tuple[str, ...], path: str) -> dict:
    """Feature rows (source1_id, target_id, label, names) as Parquet under ``path``/rows, and a manifest under ``path``/manifest.

    Gives the manifest: names, rows, positives. Raises BadTable if what was written has another number of rows than what was given.
    """
    spark = rows.sparkSession
    given = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    rows.select("source1_id", "target_id", F.col("label").cast("tinyint").alias("label"), *[F.col(c).cast("float").alias(c) for c in names]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/rows")
    written = spark.read.parquet(f"{path.rstrip('/')}/rows").count()
    if written != given["n"]:
        raise BadTable(f"{path}: {written} feature rows instead of {given['n']}")
    manifest = {"features": list(names), "rows": given["n"], "positives": given["p"]}
    write_json(spark, f"{path.rstrip('/')}/manifest", manifest)
    return manifest


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path.rstrip('/')}/rows"), read_json(spark, f"{path.rstrip('/')}/manifest")


def max_id_bytes(rows: DataFrame, column: str = "entity_id") -> DataFrame:
    """bytes: length of the longest id, 0 without any."""
    return rows.agg(F.coalesce(F.max(F.octet_length(column)), F.lit(0)).alias("bytes"))
