"""The two jobs end to end on small files, against dense algebra."""

import numpy as np
import pytest

from varve.jobs import munge, scoring, writers
from varve.sources import matrices


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    top = tmp_path_factory.mktemp("jobs")
    n, per = 48, 16
    genes = [f"G{i}" for i in range(n)]
    chrs = [str(1 + i // per) for i in range(n)]
    (top / "annot").write_text("ENSGID\tCHR\tTSS\n" + "".join(f"{g}\t{c}\t{1000 * i}\n" for i, (g, c) in enumerate(zip(genes, chrs))))
    x = rng.normal(size=(n, 9))
    (top / "features").mkdir()
    for k, (a, b) in enumerate(((0, 4), (4, 9))):
        (top / "features" / f"f{k}.txt").write_text("\t".join(["ENSGID", *(f"x{j}" for j in range(a, b))]) + "\n" + "".join("\t".join([g, *(repr(float(v)) for v in x[i, a:b])]) + "\n" for i, g in enumerate(genes)))
    z = x[:, 2] - x[:, 5] + rng.normal(size=n)
    (top / "s.genes.out").write_text("GENE  CHR  ZSTAT\n" + "".join(f"{g}   {c} {float(v)!r}\n" for g, c, v in zip(genes, chrs, z)))
    meta = [(int(rng.integers(5, 50)), int(rng.integers(2, 5)), float(rng.integers(10, 90))) for _ in genes]
    lines = []
    for i, g in enumerate(genes):
        tail = [repr(round(0.3**d, 6)) for d in range(min(3, i % per), 0, -1)]
        lines.append(" ".join([g, chrs[i], "0", "1", str(meta[i][0]), str(meta[i][1]), "9", str(meta[i][2]), "5", *tail]))
    (top / "s.genes.raw").write_text("# one\n# two\n" + "\n".join(lines) + "\n")
    munge.run(spark, str(top / "annot"), str(top / "features"), str(top / "m"), max_cols=4)
    return top, x, z, chrs, meta, genes


def dense(x, z, chrs, meta):
    n = len(z)
    sigma = np.eye(n)
    for i in range(n):
        for d in range(1, 4):
            if i - d >= 0 and chrs[i - d] == chrs[i]:
                sigma[i, i - d] = sigma[i - d, i] = round(0.3**d, 6)
    sigma += np.eye(n) * (0.05 + 0.9 * max(0, z.var() - 1) + abs(min(0, np.linalg.eigvalsh(sigma)[0])))
    w = np.linalg.inv(np.linalg.cholesky(sigma))
    s, p, m = np.array(meta).T
    c = np.column_stack([p, p / s, 1 / m])
    c = np.column_stack([c, np.log(c), np.ones(n)])
    y = z - c @ np.linalg.lstsq(w @ c, w @ z, rcond=None)[0]
    wx, wy, v = w @ x, w @ y, (w @ np.ones(n))[:, None]
    hat = v @ v.T / (v.T @ v)
    xr, yr = wx - hat @ wx, wy - hat @ wy
    beta = (xr * yr[:, None]).sum(0) / (xr * xr).sum(0)
    return y, xr, yr, beta


def test_default_run(spark, files, caplog):
    top, x, z, chrs, meta, genes = files
    caplog.set_level("INFO", "varve.jobs.scoring")
    c = scoring.Config(gene_annot_path=str(top / "annot"), feature_mat_prefix=str(top / "m"), num_feature_chunks=3, magma_prefix=str(top / "s"), feature_selection_p_cutoff=0.5, out_prefix=str(top / "out"), save_matrix_files=True)
    got = scoring.run(spark, c)
    y, xr, yr, beta = dense(x, z, chrs, meta)
    assert np.allclose([r["beta"] for r in got.marginals.orderBy("col_idx").collect()], beta)
    chosen = [int(f[1:]) for f in got.selected]
    assert chosen == sorted(chosen) and {2, 5} <= set(chosen)
    alpha = float(dict(got.coefs)["SELECTED_CV_ALPHA"])
    a = xr[:, chosen]
    want = np.linalg.solve(a.T @ a + alpha * np.eye(len(chosen)), a.T @ yr)
    assert np.allclose([float(b) for _, b in got.coefs[3:]], want)
    preds = {r["gene"]: r for r in got.preds.collect()}
    assert np.allclose([preds[g]["PoPS_Score"] for g in genes], x[:, chosen] @ want) and np.allclose([preds[g]["Y_proj"] for g in genes], y)
    text = lambda name: (top / f"out.{name}").read_text()
    assert text("preds").startswith("ENSGID\tPoPS_Score\tY\tY_proj\tproject_out_covariates_gene\tfeature_selection_gene\ttraining_gene\nG0\t")
    assert text("marginals").startswith("\tbeta\tse\tpval\tr2\tselected\nx0\t") and text("coefs").startswith("parameter\tbeta\nMETHOD\tRidgeCV\nSELECTED_CV_ALPHA\t")
    assert text("traindata").startswith("\tY_train\t") and [r.split("\t")[0] for r in text("matdata").splitlines()] == ["", *genes]
    assert [r.split("\t")[0] for r in text("preds").splitlines()] == ["ENSGID", *genes]
    assert "training: 48 genes of all chromosomes, without the HLA region (1: 16, 2: 16, 3: 16)" in caplog.text and f"{len(chosen)} of 9 features selected; 0 are nearly constant" in caplog.text and "SELECTED_CV_ALPHA" in caplog.text


def test_custom_target_stepwise_and_covariance(spark, files):
    top, x, z, chrs, _, genes = files
    (top / "y").write_text("ENSGID\tScore\n" + "".join(f"{g}\t{float(v)!r}\n" for g, v in zip(genes, z)))
    base = dict(gene_annot_path=str(top / "annot"), feature_mat_prefix=str(top / "m"), num_feature_chunks=3, y_path=str(top / "y"))
    got = scoring.run(spark, scoring.Config(**base, feature_selection_fss_num_features=2, method="linreg"))
    assert sorted(got.selected) == ["x2", "x5"] and "Y_proj" not in got.preds.columns
    sigma = np.eye(len(z)) * 2.0
    sigma[0, 1] = sigma[1, 0] = 0.5
    sigma[0, 47] = sigma[47, 0] = 0.9  # across chromosomes: dropped
    np.save(top / "cov.npy", sigma)
    got = scoring.run(spark, scoring.Config(**base, y_error_cov_path=str(top / "cov.npy"), feature_selection_p_cutoff=None, method="linreg"))
    sigma[0, 47] = sigma[47, 0] = 0
    w = np.linalg.inv(np.linalg.cholesky(sigma))
    v = np.column_stack([x, np.ones(len(z))])
    want = np.linalg.lstsq(w @ v, w @ z, rcond=None)[0][:9]
    assert np.allclose([float(b) for _, b in got.coefs[1:]], want)
    with pytest.raises(ValueError):
        scoring.run(spark, scoring.Config(gene_annot_path=str(top / "annot")))
    with pytest.raises(ValueError):
        scoring.run(spark, scoring.Config(**base, method="forest"))


def test_results_are_files_in_order(spark, tmp_path):
    """Parts of many tasks, joined; an older result, a file or a folder, is replaced, and nothing else is left."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0").write_text("old")
    rows = [(i * 7919 % 5000, f"g{i * 7919 % 5000}", None if i % 3 else float(i), i % 2 == 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "place long, ` ` string, v double, b boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            writers.write_tsv(df, str(tmp_path / "t"), "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = "\tv\tb\n" + "".join(f"{g}\t{'' if v is None else v}\t{b}\n" for _, g, v, b in sorted(rows))
    assert (tmp_path / "t").read_text() == want
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    writers.write_tsv(df.where("false"), str(tmp_path / "t"), "place")
    assert (tmp_path / "t").read_text() == "\tv\tb\n"


def test_custom_covariates_and_sparse_covariance(spark, files):
    """A covariate file, a sparse covariance and masks by chromosome, against dense algebra."""
    top, x, z, chrs, _, genes = files
    rng = np.random.default_rng(21)
    cov = rng.normal(size=(len(z), 2))
    (top / "y2").write_text("ENSGID\tScore\n" + "".join(f"{g}\t{float(v)!r}\n" for g, v in zip(genes, z)))
    (top / "cov2").write_text("ENSGID\ta\tb\n" + "".join(f"{g}\t{float(a)!r}\t{float(b)!r}\n" for g, (a, b) in reversed(list(zip(genes, cov)))))
    sigma = np.where(np.equal.outer(chrs, chrs), 0.3 ** np.abs(np.subtract.outer(np.arange(len(z)), np.arange(len(z)))), 0.0)
    row, col = np.nonzero(sigma)
    np.savez_compressed(top / "cov2.npz", indices=col, indptr=np.searchsorted(row, np.arange(len(z) + 1)), data=sigma[row, col], shape=sigma.shape, format=b"csr")
    c = scoring.Config(gene_annot_path=str(top / "annot"), feature_mat_prefix=str(top / "m"), num_feature_chunks=3, y_path=str(top / "y2"), y_covariates_path=str(top / "cov2"), y_error_cov_path=str(top / "cov2.npz"), feature_selection_p_cutoff=None, method="linreg", project_out_covariates_chromosomes=["1", "3"], training_chromosomes=["2", "3"])
    got = scoring.run(spark, c)
    whiten = lambda on: np.linalg.inv(np.linalg.cholesky(sigma[np.ix_(on, on)]))
    v = np.column_stack([cov, np.ones(len(z))])
    on = np.array([k != "2" for k in chrs])
    y = z - v @ np.linalg.lstsq(whiten(on) @ v[on], whiten(on) @ z[on], rcond=None)[0]
    assert np.allclose([r["Y_proj"] for r in got.preds.orderBy("row_idx").collect()], y)
    on = np.array([k != "1" for k in chrs])
    want = np.linalg.lstsq(whiten(on) @ np.column_stack([x, np.ones(len(z))])[on], whiten(on) @ y[on], rcond=None)[0][:9]
    assert np.allclose([float(b) for _, b in got.coefs[1:]], want)
    (top / "cov2").write_text("ENSGID\ta\n" + "".join(f"{g}\t1.5\n" for g in genes[1:]))
    with pytest.raises(ValueError, match="lack covariates"):
        scoring.run(spark, c)


def test_munge_command_line(spark, files, tmp_path):
    top, x, _, _, _, genes = files
    munge.main(["--gene_annot_path", str(top / "annot"), "--feature_dir", str(top / "features"), "--save_prefix", str(tmp_path / "n"), "--nan_policy", "zero", "--max_cols", "6"])
    chunks, layout = matrices.read_matrix(spark, str(tmp_path / "n"))
    assert layout.groupBy("chunk_id").count().orderBy("chunk_id").collect() == [(0, 6), (1, 3)] and chunks.count() == 2 * len(genes)
    munge.main(["--gene_annot_path", str(top / "annot"), "--feature_dir", str(top / "features"), "--save_prefix", str(tmp_path / "o"), "--max_cols", "6", "--arrays"])
    assert (tmp_path / "o.rows.txt").read_text().split() == genes and (tmp_path / "o.cols.1.txt").read_text() == "x6\nx7\nx8\n"
    assert np.array_equal(np.load(tmp_path / "o.mat.0.npy"), x[:, :6]) and np.array_equal(np.load(tmp_path / "o.mat.1.npy"), x[:, 6:])
    (tmp_path / "twice").write_text("ENSGID\tCHR\tTSS\nG0\t1\t1\nG0\t1\t2\n")
    with pytest.raises(ValueError, match=r"genes come twice in the annotation: \['G0'\]"):
        munge.run(spark, str(tmp_path / "twice"), str(top / "features"), str(tmp_path / "n"))


def test_import_of_arrays(spark, files):
    top, x, _, _, _, genes = files
    (top / "a.rows.txt").write_text("\n".join(genes) + "\n")
    for i, (a, b) in enumerate(((0, 5), (5, 9))):
        (top / f"a.cols.{i}.txt").write_text("\n".join(f"x{j}" for j in range(a, b)) + "\n")
        np.save(top / f"a.mat.{i}.npy", x[:, a:b].astype("<f4" if i else "<f8"))
    matrices.import_arrays(spark, str(top / "a"), 2, str(top / "b"), rows_at_once=7)
    chunks, layout = matrices.read_matrix(spark, str(top / "b"))
    assert [(r["chunk_id"], r["pos"], r["feature"]) for r in layout.orderBy("col_idx").collect()] == [(int(j > 4), j - 5 * (j > 4), f"x{j}") for j in range(9)]
    rows = {(r["chunk_id"], r["gene"]): r["x"] for r in chunks.collect()}
    assert len(rows) == 2 * len(genes) and all(np.allclose(rows[0, g] + rows[1, g], x[i], atol=1e-6) for i, g in enumerate(genes))
    assert [r["gene"] for r in matrices.read_rows(spark, str(top / "b")).orderBy("row_idx").collect()] == genes
    # the scoring job reads the arrays as they lie
    base = dict(gene_annot_path=str(top / "annot"), magma_prefix=str(top / "s"), feature_selection_p_cutoff=0.5)
    runs = [scoring.run(spark, scoring.Config(**base, feature_mat_prefix=str(top / name), num_feature_chunks=k)) for name, k in (("a", 2), ("m", 3))]
    assert runs[0].selected == runs[1].selected
    scores = [{r["gene"]: r["PoPS_Score"] for r in run.preds.collect()} for run in runs]
    assert all(abs(scores[0][g] - scores[1][g]) < 1e-5 for g in genes)
    np.save(top / "a.mat.1.npy", x[:-1, 5:])
    with pytest.raises(ValueError):
        matrices.import_arrays(spark, str(top / "a"), 2, str(top / "c"))


def test_arguments():
    c = scoring.arguments(["--gene_annot_path", "a", "--feature_mat_prefix", "m", "--num_feature_chunks", "2", "--ignore_magma_covariates", "--training_chromosomes", "1", "2", "--no_verbose"])
    assert not c.use_magma_covariates and c.training_chromosomes == ["1", "2"] and c.feature_selection_p_cutoff == 0.05 and c.random_seed == 42
