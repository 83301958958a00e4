"""Queries and sources on keys, rows and files that the small tables do not have."""

import os

import duckdb
import numpy as np
import pytest

from quadrille import registry
from quadrille.operators import mesh
from quadrille.plans import mesh_queries
from quadrille.sources import las


def parts(path, keys):
    duckdb.connect().sql(f"copy (select cast(unnest({keys}) as bigint) as p_partkey, 'Brand#13' as p_brand, 't' as p_type, cast(7 as integer) as p_size) to '{path}/part.parquet' (format parquet)")
    return str(path)


def test_byte_display_of_products_beyond_64_bits(spark, tmp_path):
    keys = [0, 1, 6, 7, 53, 54, 535, 536, 1_096_302, 1_096_303, 1_200_000, 50_000_000, 1_000_000_000_000]

    def shown(b):
        return next((f"{b >> s}{u}" for s, u in ((30, "GB"), (20, "MB"), (10, "KB")) if b >> s), f"{b}bytes")

    got = registry.QUERIES["byte_display"](spark, parts(tmp_path, keys)).collect()
    assert sorted((r.feature_id, r.shown) for r in got) == sorted((k, shown(7 * k**3)) for k in keys)


def test_kernels_run_once_for_equal_values(spark, tmp_path):
    folder = str(tmp_path)

    def fn(w, h):
        with open(os.path.join(folder, f"{w}-{h}"), "a") as f:
            f.write("x")
        return (None if w is None else w * 10.0, h)

    rows = [(k, None if k % 5 == 0 else float(k % 5), float(k % 2)) for k in range(200)] + [(3, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, w double, h double")
    got = mesh_queries.once(df, fn, "k long, w double, h double").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, None if w is None else w * 10.0, h)) for k, w, h in rows)
    assert len(os.listdir(folder)) == 10 and all(os.path.getsize(os.path.join(folder, n)) == 1 for n in os.listdir(folder))


@pytest.mark.parametrize("name", ["voxel_isosurface", "decimate_meshes"])
def test_footprints_of_equal_sides_share_a_kernel_call(spark, tmp_path, name):
    """20,000 footprints of one size: 190 s and more of kernel calls if each had its own."""
    plan = registry.QUERIES[name](spark, parts(tmp_path, list(range(20_000))))
    assert plan.count() == 20_000 and len(plan.drop("feature_id").distinct().collect()) == 1


def test_boundary_edges_as_by_plain_code():
    rng = np.random.default_rng(1)
    for _ in range(30):
        f = rng.integers(0, 6, (rng.integers(0, 20), 3)).astype(np.int32)
        left = {}
        for a, b in np.concatenate((f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]])).tolist():
            if left.get((b, a), 0):
                left[b, a] -= 1
            else:
                left[a, b] = left.get((a, b), 0) + 1
        assert sorted(map(tuple, mesh.boundary_edges(f).tolist())) == sorted(ab for ab, k in left.items() for _ in range(k))


def test_quality_is_trained_outside_the_driver(spark, sf_dir, monkeypatch):
    """The driver's process gets the model only: counts and descent are an executor's."""
    from quadrille.llm import quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(quality.Packed, "__getitem__", lambda self, k: pytest.fail("a training row is unpacked in the driver"))
    logit, bias = quality.fit(docs, labels)
    assert logit.shape == (quality.KINDS << quality.BITS,) and np.abs(logit).max() > 0 and np.isfinite(bias)


def test_small_las_files_share_tasks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    for k in range(120):
        n = 1 + k % 7
        las.write_las(f"{tmp_path}/{k:03}.las", rng.integers(0, 99, (n, 3)).astype(float), np.full((n, 3), k), np.arange(n), np.full(n, k % 19))
    want = sorted((f"{k:03}.las", i, k % 19) for k in range(120) for i in range(1 + k % 7))
    spark.dataSource.register(las.LasDataSource)
    found = spark.read.format("las").option("records", 2).load(str(tmp_path))
    assert sorted((os.path.basename(r.path), r.point_index, r.classification) for r in found.collect()) == want and found.rdd.getNumPartitions() == 1
    # a large file is still dealt by records
    monkeypatch.setattr(las, "PACK", 500)
    reader = las.LasReader({"path": str(tmp_path), "records": 2})
    slices = [s for p in reader.partitions() for s in p.slices]
    assert ("006.las", 4, 6) in [(os.path.basename(p), a, z) for p, a, z in slices]
    got = [(os.path.basename(b.column(0)[i].as_py()), b.column(1)[i].as_py(), b.column(6)[i].as_py()) for p in reader.partitions() for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(got) == want
