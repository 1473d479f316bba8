"""Staged runs with gates that can be taken up again (PIPE-1).

A stage maps a DataFrame to (DataFrame, report DataFrame, status), and to the folder
of the DataFrame where it has written it itself. Stages run in
order and the run goes on only while the status is PASS / OK / WARN. A finished
stage's output and report are written once under the run's folder, with a manifest
row: position, name, fingerprint of its input, paths, status and rows. A later run
with the same folder reads the manifest and takes over every leading stage whose
name and input fingerprint agree; the first that differs, or is missing because the
run was ended, starts anew from the output before it. A fingerprint does not depend
on row order or file layout.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

GO = {"PASS", "OK", "WARN"}


MANIFEST = "position int, stage string, input string, output string, output_path string, report_path string, status string, rows long, finished timestamp"


@dataclass
class StageResult:
    name: str
    data: DataFrame
    report: DataFrame
    status: str
    rows: int = 0
    resumed: bool = False


Stage = Callable[[DataFrame], tuple]  # (data, report, status) or (data, report, status, folder that holds the data)


def domain_stage(domain: str | None = None) -> Stage:
    """Match of the table's filled columns with the domain's expected ones (the best
    suggestion when none is given); STOP below the lower threshold."""
    def run(df):
        from tessera.operators import domain as dom
        catalog = dom.column_catalog({"main": df})
        chosen = domain or dom.suggest(catalog).filter("rank = 1").first()["domain"]
        report = dom.compatibility(catalog).filter(F.col("domain") == chosen)
        return df, report, report.first()["status"]
    return run


def ingest_stage(folder: str) -> Stage:
    """The table landed as zstd Parquet under ``folder``, with its inventory; an
    empty table stops the run."""
    def run(df):
        from tessera.sources import landing
        path = landing.land_parquet(df, f"{folder.rstrip('/')}/landed-{uuid.uuid4().hex}")
        landed = df.sparkSession.read.schema(df.schema).parquet(path)
        report = landing.landing_inventory(df.sparkSession, {"main": path})
        return landed, report, "STOP" if landed.isEmpty() else "OK", path
    return run


def quality_stage(keys: list[str], order_cols: list[str], as_of: dt.datetime) -> Stage:
    def run(df):
        from tessera.operators import quality as qc
        from tessera.sources import landing
        path = landing.scratch_path(df.sparkSession, "clean")
        out = qc.run_quality_control(df, keys, order_cols, as_of, path)
        return out["data"], out["missing"], out["status"].first()["status"], *([path] if out["data"].columns else [])
    return run


def schema_stage() -> Stage:
    def run(df):
        from tessera.operators import schema as sch
        typed, plan = sch.infer_and_cast(df)
        v = sch.schema_violations(typed)
        return typed, plan, v.first()["status"]
    return run


def impute_stage(group_col: str | None = None) -> Stage:
    def run(df):
        from tessera.operators import impute as imp
        res = imp.run_imputation(df, group_col)
        return res.data, res.decisions, res.status()
    return run


def feature_stage(domain: str) -> Stage:
    def run(df):
        from tessera.operators.features import feature_draft
        out, specs, _ = feature_draft(df, domain)
        return out, specs, "PASS"
    return run


def _manifest(spark: SparkSession, path: str) -> dict[int, dict]:
    """Latest row by position; none where no run has been."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    # one row per finished stage
    return {r["position"]: r.asDict() for r in spark.read.schema(MANIFEST).parquet(path).orderBy("position", "finished").collect()}


def _fingerprint(df: DataFrame) -> tuple[str, int]:
    from tessera.sources.landing import fingerprint
    r = fingerprint(df).first()
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{r['rows']}:{r['fingerprint']}:{uuid.uuid5(uuid.NAMESPACE_OID, types).hex}", r["rows"]


def run_stages(df: DataFrame, stages: list[tuple[str, Stage]], folder: str | None = None) -> list[StageResult]:
    """Run the stages in order until one does not pass. The input and each stage's
    output are written once, so later stages, reports and counts read them and never
    repeat the stages (or the joins of the input) before; a table that a stage passes
    on as it is, or has written itself, is not written again. With ``folder`` an
    earlier run's finished stages are taken over."""
    spark = df.sparkSession
    folder = (folder or f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}").rstrip("/")
    path = f"{folder}/manifest"
    done, going = _manifest(spark, path), True
    results: list[StageResult] = []
    at = f"{folder}/input-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    cur = spark.read.schema(df.schema).parquet(at)
    print_, rows = _fingerprint(cur)
    for i, (name, stage) in enumerate(stages):
        old = done.get(i)
        going = going and old is not None and old["stage"] == name and old["input"] == print_
        if going:
            data, report = spark.read.parquet(old["output_path"]), spark.read.parquet(old["report_path"])
            results.append(StageResult(name, data, report, old["status"], old["rows"], True))
            status, print_, at, rows = old["status"], old["output"], old["output_path"], old["rows"]
        else:
            data, report, status, *kept = stage(cur)
            where, before = f"{folder}/{i}-{name}-{uuid.uuid4().hex}", print_
            report.write.parquet(f"{where}/report")
            report = spark.read.parquet(f"{where}/report")
            if data is not cur:
                at = kept[0] if kept else f"{where}/data"
                if not kept:
                    data.write.option("compression", "zstd").parquet(at)
                data = spark.read.parquet(at)
                print_, rows = _fingerprint(data)
            spark.createDataFrame([(i, name, before, print_, at, f"{where}/report", status, rows, dt.datetime.now())], MANIFEST).coalesce(1) \
                 .write.mode("append").parquet(path)
            results.append(StageResult(name, data, report, status, rows))
        if status not in GO:
            break
        cur = data
    return results
