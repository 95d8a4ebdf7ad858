"""Readers and writers of tables, gene-set files and JSON artifacts."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

COUNTS = StructType([StructField("cell_id", StringType()), StructField("gene_id", StringType()), StructField("n", LongType())])
EDGES = StructType([StructField("src", LongType()), StructField("dst", LongType()), StructField("weight", DoubleType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_folder(spark: SparkSession) -> str:
    """A folder that all of the session's machines see, where none is set: a temporary one of a local session, else one in the warehouse."""
    if spark.sparkContext.master.startswith("local["):
        return "file://" + tempfile.mkdtemp(prefix="cytoquill-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cytoquill-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, which cuts its lineage; a folder of our own only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or own_folder(df.sparkSession))
    return df.checkpoint()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Long counts from Parquet; columns are matched by name, a missing one is an error."""
    return spark.read.schema(COUNTS).parquet(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Long counts as Parquet, sorted within files by gene so that gene filters skip row groups."""
    counts.select([f.name for f in COUNTS]).sortWithinPartitions("gene_id", "cell_id").write.parquet(path)


def write_tsv_gz(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, compression="gzip")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def parse_gmt(lines: DataFrame, library: str) -> DataFrame:
    """``library, pathway, genes`` from rows ``value``: name, a field that is ignored, genes, by tabs.

    Blank genes are dropped, and lines without a gene; of lines with one name the last of its file counts.
    """
    parts = F.split("value", "\t")
    rows = lines.select(F.monotonically_increasing_id().alias("at"), parts.alias("p")).where((F.size("p") > 2) & (F.trim(F.col("p")[0]) != ""))
    genes = F.filter(F.transform(F.slice("p", F.lit(3), F.size("p")), lambda g: F.trim(g)), lambda g: g != "")
    rows = rows.select("at", F.trim(F.col("p")[0]).alias("pathway"), genes.alias("genes")).where(F.size("genes") > 0)
    return rows.groupBy("pathway").agg(F.max_by("genes", "at").alias("genes")).select(F.lit(library).alias("library"), "pathway", "genes")


def read_gmt(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """All libraries of ``paths`` (library -> path) in one table."""
    out: DataFrame | None = None
    for library, path in paths.items():
        one = parse_gmt(spark.read.text(path), library)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no library is given")
    return out


def resolve_libraries(spec: str | Sequence[str] | None, available: Iterable[str]) -> list[str]:
    """Libraries that a spec names, in its order, each once.

    None, ``all`` and ``*`` mean all; a name means itself, or else all that begin with it and a dot
    or equal it up to the first dot. FileNotFoundError if a name fits nothing.
    """
    have = sorted(available)
    out: list[str] = []
    for s in ["all"] if spec is None else [spec] if isinstance(spec, str) else spec:
        found = have if s in ("all", "*") else [s] if s in have else [x for x in have if x.startswith(s.removesuffix(".all") + ".") or x == s.removesuffix(".all")]
        if not found:
            raise FileNotFoundError(f"no gene-set library fits {s!r}; there are {', '.join(have)}")
        out += [x for x in found if x not in out]
    return out


def library_paths(spark: SparkSession, folders: Sequence[str], suffix: str = ".gmt") -> dict[str, str]:
    """Library -> path of the gene-set files of some folders, through Spark's file system; of one name the first folder's counts, folders that aren't there are passed over."""
    out: dict[str, str] = {}
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []
        for name in names:
            if name.endswith(suffix):
                out.setdefault(name.removesuffix(suffix), f"{folder.rstrip('/')}/{name}")
    return out


def load_libraries(spark: SparkSession, spec: str | Sequence[str] | None, folders: Sequence[str]) -> DataFrame:
    """The libraries that ``spec`` names (see ``resolve_libraries``), each from the first of ``folders`` that has it: a user's own, then those shipped elsewhere."""
    paths = library_paths(spark, folders)
    return read_gmt(spark, {name: paths[name] for name in resolve_libraries(spec, paths)})


def correlation_artifact_fields(artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``artifacts`` (…, provenance: JSON text) with a column for each key; bad JSON gives nulls."""
    schema = "map<string,string>"
    parsed = F.from_json("provenance", schema, {"mode": "PERMISSIVE"})
    return artifacts.withColumns({k: parsed[k] for k in keys}).withColumn("provenance_sha256", F.sha2("provenance", 256))


def artifact_index(corr: DataFrame, cutoffs: DataFrame, require_splits: bool = False) -> DataFrame:
    """A row for each sample and split of ``corr`` (sample, split, gene_a, gene_b, rho): genes, cutoffs, how many splits the sample has, and whether each pair stands there once.

    With ``require_splits`` a sample of fewer than two splits raises ValueError.
    """
    pairs = corr.groupBy("sample", "split").agg((F.count("*") == F.count_distinct(F.struct("gene_a", "gene_b"))).alias("pairs_unique"))
    ids = corr.select("sample", "split", F.explode(F.array("gene_a", "gene_b")).alias("gene_id"))
    n = ids.groupBy("sample", "split").agg(F.count_distinct("gene_id").alias("n_genes"))
    both = n.groupBy("sample").agg(F.count("*").alias("n_splits"))
    if require_splits and (bad := both.where("n_splits < 2").first()) is not None:
        raise ValueError(f"sample {bad['sample']!r} lacks a split")
    return n.join(both, "sample").join(pairs, ["sample", "split"]).join(cutoffs, ["sample", "split"], "left")


#: Rows of a report in one JSON text, at most.
MOST_ROWS = 100_000


def write_json(rows: DataFrame | Mapping, path: str, spark: SparkSession | None = None) -> str:
    """Canonical JSON of a report of ``MOST_ROWS`` rows at most (more raise ValueError), written as one text file through Spark's file system; returns the text."""
    value = dict(rows) if isinstance(rows, Mapping) else [r.asDict(True) for r in rows.limit(MOST_ROWS + 1).collect()]
    if len(value) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows; write a table instead")
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, allow_nan=False)
    session = spark or (rows.sparkSession if isinstance(rows, DataFrame) else SparkSession.getActiveSession())
    session.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return text
