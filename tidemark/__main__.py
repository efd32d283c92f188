"""Command line: ``convert`` raw extracts, ``cluster`` them by entity, run the ``etl``, the ``scaled`` features, or the ``model`` comparison."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ENTITY, StudyParams
from .operators import cohort, evaluate, model
from .plans import etl, modelling, raw
from .plans.records import Study, restricted
from .plans.scaled import ScaledFeatures
from .session import staging, tune
from .sources import writers


def _study(spark: SparkSession, args: argparse.Namespace) -> Study:
    params = StudyParams(**{f.name: getattr(args, f.name) for f in dataclasses.fields(StudyParams)})
    records = raw.load_converted(spark, args.input) if args.parquet else raw.load_records(spark, args.input)
    if args.sample:
        ids = records.patients.select(F.col("SUBJECT_ID").alias(ENTITY))
        frozen = writers.freeze_ids(cohort.entity_sample(ids, args.sample, params.seed), f"{args.output}/sample_ids")
        records = restricted(records, frozen)
    return Study(records, params)


def _factory(text: str) -> tuple[str, Callable]:
    """``name=module:callable``; the callable makes an encoder on a worker."""
    name, _, place = text.partition("=")
    module, _, attribute = place.partition(":")
    return name, getattr(importlib.import_module(module), attribute)


def _model(spark: SparkSession, study: Study, args: argparse.Namespace) -> None:
    """All models on written features: AUC overall and by respiratory cohort, importances, saved forests."""
    built = {name: spark.read.parquet(f"{args.features}/{name}") for name in etl.OUTPUTS}
    forest = model.random_forest(args.trees, args.depth, study.params.seed)
    encoders = dict(map(_factory, args.encoder))
    fitted = modelling.study_models(study, built, encoders, f"{args.output}/embeddings", forest)
    auc = None
    for name, result in fitted.items():
        row = evaluate.roc_auc(result.scores).withColumn("model", F.lit(name))
        auc = row if auc is None else auc.unionByName(row)
        if result.model is not None:
            model.save_model(result.model, f"{args.output}/models/{name}")
        if hasattr(result.model, "featureImportances"):
            top = model.top_importances(result.model, result.matrix.codes, study.params.top_features)
            writers.write_parquet(top, f"{args.output}/importances/model={name}")
    writers.write_parquet(auc, f"{args.output}/auc")
    writers.write_parquet(modelling.compare(fitted, modelling.respiratory_entities(study)), f"{args.output}/cohort_auc")
    for table in ("auc", "cohort_auc"):
        spark.read.parquet(f"{args.output}/{table}").show(100, truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=["convert", "cluster", "etl", "scaled", "model"])
    parser.add_argument("--input", required=True, help="folder of the raw extracts")
    parser.add_argument("--output", required=True, help="folder for results")
    parser.add_argument("--parquet", action="store_true", help="the input was made by convert")
    parser.add_argument("--features", help="output folder of etl, for model")
    parser.add_argument("--sample", type=int, help="work on this many entities")
    parser.add_argument("--files", type=int, default=64, help="parts per table, for convert")
    parser.add_argument("--quarantine", action="store_true", help="put lines that do not fit their types aside, for convert")
    parser.add_argument("--buckets", type=int, help="cluster the converted tables by entity into this many buckets, for cluster")
    parser.add_argument("--encoder", action="append", default=[], help="name=module:callable, for model; may be repeated")
    parser.add_argument("--trees", type=int, default=100, help="of a forest, for model")
    parser.add_argument("--depth", type=int, default=30, help="of a forest's trees, for model")
    for field in dataclasses.fields(StudyParams):
        flag = "--" + field.name.replace("_", "-")
        parser.add_argument(flag, type=type(field.default), default=field.default)
    args = parser.parse_args(argv)

    spark = tune(SparkSession.builder.appName(f"tidemark-{args.command}").getOrCreate())
    if args.command == "cluster":
        raw.cluster(raw.load_converted(spark, args.input), args.output, args.buckets or args.files).show(truncate=False)
        return
    if args.command == "convert" and args.quarantine:
        with staging(spark):
            for table, (lines, clean, rejected) in raw.convert_with_quarantine(spark, args.input, args.output, args.files).items():
                print(f"{table}: {lines} lines, {clean} clean, {rejected} rejected")
        return
    if args.command == "convert":
        for table, misfits in raw.convert(spark, args.input, args.output, args.files).items():
            print(f"{table}: {misfits} lines do not fit their types")
        return
    with staging(spark):
        study = _study(spark, args)
        if args.command == "etl":
            etl.run(study, args.output)
        elif args.command == "scaled":
            ScaledFeatures(study).write(args.output)
        else:
            _model(spark, study, args)


if __name__ == "__main__":
    main()
