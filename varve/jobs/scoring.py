"""The scoring job: read a target, project covariates out, associate, select, fit, predict, write."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import association, covariance, fit, masks, predict, project, select
from ..sources import files, matrices
from .shipping import ship
from .writers import write_tsv

log = logging.getLogger(__name__)
#: A column of result tables that says their order, and that no feature is called.
ORDER = "_order of rows_"


@dataclass(frozen=True)
class Config:
    """All options, under their command-line names."""

    gene_annot_path: str = ""
    feature_mat_prefix: str = ""
    num_feature_chunks: int = 0
    magma_prefix: str | None = None
    use_magma_covariates: bool = True
    use_magma_error_cov: bool = True
    y_path: str | None = None
    y_covariates_path: str | None = None
    y_error_cov_path: str | None = None
    project_out_covariates_chromosomes: list[str] | None = None
    project_out_covariates_remove_hla: bool = True
    subset_features_path: str | None = None
    control_features_path: str | None = None
    feature_selection_chromosomes: list[str] | None = None
    feature_selection_p_cutoff: float | None = 0.05
    feature_selection_max_num: int | None = None
    feature_selection_fss_num_features: int | None = None
    feature_selection_remove_hla: bool = True
    training_chromosomes: list[str] | None = None
    training_remove_hla: bool = True
    method: str = "ridge"
    out_prefix: str | None = None
    save_matrix_files: bool = False
    random_seed: int = 42
    verbose: bool = False


@dataclass
class Results:
    marginals: DataFrame
    coefs: list[tuple[str, str]]
    preds: DataFrame
    training: DataFrame
    selected: list[str] = field(default_factory=list)


def read_target(spark: SparkSession, c: Config, annotation: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(target, covariates, blocks); the gene statistics win over a custom target."""
    if c.magma_prefix is not None:
        y = files.gene_scores(spark, f"{c.magma_prefix}.genes.out")
        raw = files.gene_correlations(spark, f"{c.magma_prefix}.genes.raw")
        if y.join(raw.select("y_idx", F.col("gene").alias("other")), "y_idx", "full").where("gene is null or other is null or gene <> other").limit(1).count():
            raise ValueError("the two files of gene statistics list different genes")
        if not covariance.contiguous(raw).first()["contiguous"]:
            raise ValueError("a chromosome's genes are not together")
        cov = covariance.control_covariates(raw) if c.use_magma_covariates else None
        if cov is not None and (lacking := [r[0] for r in cov.where("c is null").select("gene").limit(5).collect()]):
            raise ValueError(f"counts of genes are not above 0: {lacking}")
        return y, cov, covariance.block_rows(raw.select("y_idx", "gene", "chr", "r")) if c.use_magma_error_cov else None
    if c.y_path is not None:
        y = files.target(spark, c.y_path)
        cov = files.custom_covariates(spark, c.y_covariates_path) if c.y_covariates_path else None
        return y, cov, matrices.read_covariance(spark, c.y_error_cov_path, y, annotation) if c.y_error_cov_path else None
    raise ValueError("give gene statistics or a custom target")


def relabelled(blocks: DataFrame, annotation: DataFrame) -> DataFrame:
    """Blocks by the annotation's chromosome; what lies across its chromosomes is dropped with the change of block."""
    if blocks.join(annotation, "gene", "left_anti").limit(1).count():
        raise ValueError("genes of the error covariance lack an annotation")
    other = blocks.join(annotation.select("gene", F.col("chr").alias("own")), "gene")
    if not other.where("chr <> own").limit(1).count():
        return blocks
    return covariance.regrouped(other)


def whitened(blocks: DataFrame, genes: DataFrame, added: float, *values: DataFrame) -> list[DataFrame]:
    """Each of values (chunk_id, gene, x) of ``genes``, whitened by the factor of their own covariance. Results are kept, as the steps read them several times."""
    factors = covariance.factors(covariance.masked_blocks(blocks, genes), added)
    return [covariance.whiten(v, factors).select("chunk_id", "gene", "x").persist() for v in values]


def told(genes: DataFrame, annotation: DataFrame, chromosomes: list[str] | None, without_hla: bool) -> str:
    """How many genes a step uses, by chromosome. A job, so only for a log that is on."""
    per = annotation.join(genes, "gene", "left_semi").groupBy("chr").count().orderBy(*masks.natural_order(F.col("chr"))).collect()
    which = "all chromosomes" if chromosomes is None else f"chromosomes {', '.join(chromosomes)}"
    return f"{sum(r['count'] for r in per)} genes of {which}, {'without' if without_hla else 'with'} the HLA region ({', '.join(f'{r["chr"]}: {r["count"]}' for r in per)})"


def run(spark: SparkSession, c: Config) -> Results:
    ship(spark)
    log.info("options: %s", c)
    if c.method not in fit.METHODS:
        raise ValueError(f"method is one of {', '.join(fit.METHODS)}")
    annotation = files.annotation(spark, c.gene_annot_path)
    y, cov, blocks = read_target(spark, c, annotation)
    added = 0.0
    if blocks is not None:
        blocks = relabelled(blocks, annotation).cache()
        if c.magma_prefix is not None:
            added = covariance.regularisation(blocks, y)
            log.info("the error covariance has %g added to its diagonal", added)
    log.info("target from %s, %s, %s", c.magma_prefix or c.y_path, "no covariates" if cov is None else "with covariates", "no error covariance" if blocks is None else "with an error covariance")
    used = {}
    for name, chromosomes, remove in (("project", c.project_out_covariates_chromosomes, c.project_out_covariates_remove_hla), ("select", c.feature_selection_chromosomes, c.feature_selection_remove_hla), ("train", c.training_chromosomes, c.training_remove_hla)):
        if chromosomes is not None:
            masks.checked_chromosomes(annotation, chromosomes)
        used[name] = masks.gene_mask(y, annotation, chromosomes, remove).where("used").select("gene")
        if log.isEnabledFor(logging.INFO):
            log.info("%s: %s", {"project": "projection of covariates", "select": "association and selection", "train": "training"}[name], told(used[name], annotation, chromosomes, remove))
    y_proj = y.select("gene", "y")
    if cov is not None:
        white = None
        if blocks is not None:
            rows = y.join(project.with_intercept(cov), "gene").select(F.lit(0).alias("chunk_id"), "gene", F.concat(F.array("y"), "c").alias("x"))
            white = whitened(blocks, used["project"], added, rows.join(used["project"], "gene", "left_semi"))[0].select("gene", F.col("x")[0].alias("y"), F.slice("x", 2, F.size("x") - 1).alias("c"))
        y_proj = project.project_out(y, cov, used["project"], white)
    chunks, layout = matrices.read_matrix(spark, c.feature_mat_prefix, c.num_feature_chunks)
    matrix_rows = matrices.read_rows(spark, c.feature_mat_prefix)
    if log.isEnabledFor(logging.INFO):
        log.info("%d genes in the target, %d rows in the matrix, %d features in %d chunks", y.count(), matrix_rows.count(), layout.count(), layout.select("chunk_id").distinct().count())
    for name, genes in used.items():
        if (n := genes.join(matrix_rows, "gene", "left_anti").count()) and name != "project":
            raise ValueError(f"{n} genes of the target ({name}) are not in the matrix")
    held: list[DataFrame] = []

    def prepared(genes: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
        basis = y_proj.join(genes, "gene", "left_semi").select(F.lit(-1).alias("chunk_id"), "gene", F.array("y", F.lit(1.0)).alias("x"))
        own = values.join(genes, "gene", "left_semi")
        if blocks is not None:
            basis, own = whitened(blocks, genes, added, basis, own)
            held.extend((basis, own))
        return own, basis.select("gene", F.col("x")[0].alias("y"), F.array(F.col("x")[1]).alias("v"))

    own, basis = prepared(used["select"], chunks)
    marginals = association.marginal(own, basis).join(layout, ["chunk_id", "pos"]).cache()
    if c.feature_selection_fss_num_features is not None:
        picked = association.forward_stepwise(own, basis, c.feature_selection_fss_num_features)
        log.info("stepwise selection of %d features, in place of all other rules", len(picked))
        ranks = spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(picked)], "chunk_id int, pos int, selection_rank int")
        marginals = marginals.join(F.broadcast(ranks), ["chunk_id", "pos"], "left").withColumn("selected", F.col("selection_rank").isNotNull())
    else:
        lists = {k: files.names(spark, p) if p else None for k, p in (("controls", c.control_features_path), ("only", c.subset_features_path))}
        marginals = select.select_features(marginals, c.feature_selection_p_cutoff, c.feature_selection_max_num, **lists)
    chosen = marginals.where("selected").select("chunk_id", "pos", "col_idx", "feature").orderBy("col_idx").collect()
    if not chosen:
        raise ValueError("no feature is selected")
    picked = spark.createDataFrame([(r["chunk_id"], r["pos"], r["col_idx"]) for r in chosen], "chunk_id int, pos int, col_idx long")
    for df in held:
        df.unpersist()
    held.clear()
    if log.isEnabledFor(logging.INFO):
        n, flat, below = marginals.agg(F.count(F.lit(1)), F.count_if(F.col("pval").isNull()), F.count_if(F.col("pval") < (c.feature_selection_p_cutoff if c.feature_selection_p_cutoff is not None else 2.0))).first()
        log.info("%d of %d features selected; %d are nearly constant, %d below the cutoff of p (%s), most allowed: %s; subset %s, controls %s", len(chosen), n, flat, below, c.feature_selection_p_cutoff, c.feature_selection_max_num, c.subset_features_path, c.control_features_path)
    x = predict.pick(chunks, picked).select(F.lit(0).alias("chunk_id"), "gene", "x")
    own, basis = prepared(used["train"], x)
    order = y.select("gene", F.col("y_idx").alias("order"))
    training = project.residual_values(own.select("gene", "x"), basis).join(order, "gene").cache()
    numbered = training.drop("order").join(matrices.ranked(training.select("gene", "order")), "gene") if c.method == "lasso" else training
    fitted = fit.fit(numbered, c.method, c.random_seed)
    for df in held:
        df.unpersist()
    beta = spark.createDataFrame([(r["chunk_id"], r["pos"], float(b)) for r, b in zip(chosen, fitted.coef, strict=True)], "chunk_id int, pos int, beta double")
    log.info("fitted %d coefficients, %d not 0: %s", len(fitted.coef), int((fitted.coef != 0).sum()), ", ".join(f"{k} {v}" for k, v in fitted.meta.items()))
    scores = predict.predict(chunks, beta).withColumnRenamed("score", "PoPS_Score")
    named = {"feature_selection_gene": used["select"], "training_gene": used["train"]}
    if cov is not None:
        named = {"project_out_covariates_gene": used["project"], **named}
    preds = predict.annotate(scores, y, named, y_proj if cov is not None else None)
    coefs = [*fitted.meta.items(), *((r["feature"], repr(float(b))) for r, b in zip(chosen, fitted.coef, strict=True))]
    out = Results(marginals, coefs, preds.join(matrix_rows, "gene"), training, [r["feature"] for r in chosen])
    if c.out_prefix:
        write(spark, c, out, x.join(matrix_rows, "gene"))
        log.info("written to %s.*", c.out_prefix)
    return out


def write(spark: SparkSession, c: Config, r: Results, x: DataFrame) -> None:
    extra = ["selection_rank"] if "selection_rank" in r.marginals.columns else []
    write_tsv(r.marginals.select(F.col("feature").alias(" "), "beta", "se", "pval", "r2", "selected", *extra, F.col("col_idx").alias(ORDER)), f"{c.out_prefix}.marginals", ORDER)
    coefs = spark.createDataFrame([(i, *row) for i, row in enumerate(r.coefs)], f"`{ORDER}` long, parameter string, beta string")
    write_tsv(coefs, f"{c.out_prefix}.coefs", ORDER)
    columns = [k for k in ("PoPS_Score", "Y", "Y_proj", "project_out_covariates_gene", "feature_selection_gene", "training_gene") if k in r.preds.columns]
    write_tsv(r.preds.select(F.col("gene").alias("ENSGID"), *columns, F.col("row_idx").alias(ORDER)), f"{c.out_prefix}.preds", ORDER)
    if c.save_matrix_files:
        wide = [F.col("x")[i].alias(name) for i, name in enumerate(r.selected)]
        write_tsv(r.training.select(F.col("gene").alias(" "), F.col("y").alias("Y_train"), *wide, F.col("order").alias(ORDER)), f"{c.out_prefix}.traindata", ORDER)
        write_tsv(x.select(F.col("gene").alias(" "), *wide, F.col("row_idx").alias(ORDER)), f"{c.out_prefix}.matdata", ORDER)


def arguments(argv: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(description=__doc__)
    pairs = {"use_magma_covariates": "ignore_magma_covariates", "use_magma_error_cov": "ignore_magma_error_cov", "project_out_covariates_remove_hla": "project_out_covariates_keep_hla", "feature_selection_remove_hla": "feature_selection_keep_hla", "training_remove_hla": "training_keep_hla", "save_matrix_files": "no_save_matrix_files", "verbose": "no_verbose"}
    for f in fields(Config):
        if f.name in pairs:
            p.add_argument(f"--{f.name}", dest=f.name, action="store_true", default=f.default)
            p.add_argument(f"--{pairs[f.name]}", dest=f.name, action="store_false")
        elif f.name.endswith("chromosomes"):
            p.add_argument(f"--{f.name}", nargs="*")
        else:
            kind = float if f.name.endswith("cutoff") else int if f.name in ("num_feature_chunks", "feature_selection_max_num", "feature_selection_fss_num_features", "random_seed") else str
            p.add_argument(f"--{f.name}", type=kind, default=f.default)
    return Config(**vars(p.parse_args(argv)))


def main(argv: list[str] | None = None) -> None:
    c = arguments(argv)
    logging.basicConfig(level=logging.INFO if c.verbose else logging.WARNING)
    run(SparkSession.builder.appName(Path(__file__).stem).getOrCreate(), c)


if __name__ == "__main__":
    main()
