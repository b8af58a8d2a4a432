import numpy as np
import pytest
from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan, StringContains
from tessella.sources import arrays as A
from tessella.sources import tables as T


def test_cube(spark, tmp_path):
    cube = np.random.default_rng(1).normal(size=(5, 4, 30)).astype(np.float32)
    cube[2, 3, 29] = np.nan
    np.save(tmp_path / "c.npy", cube)
    path = str(tmp_path / "c.npy")
    rows = {(r.site_id, r.t): r.z for r in T.read_cube(spark, path, 3, keep=10).collect()}
    assert len(rows) == 49 and (2, 9) not in rows
    assert all(abs(v - cube[i, 3, 20 + t]) < 1e-6 for (i, t), v in rows.items())
    for bad in ({"variable": 4}, {"variable": 1, "keep": 31}):
        with pytest.raises(ValueError):
            T.read_cube(spark, path, **bad)
    T.save_cube_part(spark, path, str(tmp_path / "part"), 3, 10)
    assert spark.read.parquet(str(tmp_path / "part")).count() == 49


def whole(spark, path):
    """The cube of a folder, by its own reader."""
    shape = T.cube_shape(path)
    out = np.full(shape, np.nan)
    for r in A.registered(spark).read.format("tessella_cube").load(path).collect():
        out[r.site_id, r.variable, r.t] = r.z
    return out


@pytest.mark.parametrize("sites", [64, 2])
def test_cube_is_written_by_sites(spark, tmp_path, sites):
    rng = np.random.default_rng(2)
    want = np.where(rng.random((5, 2, 3)) < 0.4, np.nan, rng.normal(size=(5, 2, 3)))
    want[:, 0, 0] = 1
    cells = spark.createDataFrame([(int(i), int(v), int(t), float(want[i, v, t])) for i, v, t in zip(*np.nonzero(np.isfinite(want)))], "i long, variable int, t long, value double")
    path = "file://" + str(tmp_path / "w")
    T.write_cube(cells, path, (5, 2, 3), sites)
    files = sorted(f.name for f in (tmp_path / "w").iterdir() if not f.name.startswith("."))
    assert files == sorted(["_SUCCESS", *(f"sites_{i:012d}.npy" for i in range(0, 5, sites))])
    assert np.array_equal(whole(spark, path), want, equal_nan=True)
    with pytest.raises(Exception, match="a site has no cell"):
        T.write_cube(cells, str(tmp_path / "more"), (6, 2, 3), sites)
    assert not (tmp_path / "more").exists() or not list((tmp_path / "more").iterdir())


def test_filters_read_fewer_bytes(spark, tmp_path):
    cube = np.random.default_rng(3).normal(size=(40, 5, 100)).astype(np.float32)
    np.save(tmp_path / "c.npy", cube)
    path = str(tmp_path / "c.npy")
    every = A.CubeReader(path, {})
    some = A.CubeReader(path, {"sites": 7})
    other = StringContains(("t",), "1")
    filters = [In(("variable",), (3, 9)), GreaterThanOrEqual(("t",), 90), LessThan(("site_id",), 10), other]
    assert list(some.pushFilters(filters)) == [other]
    assert every.planned() == 40 * (2 + 5 * 100) * 4 and some.planned() == 10 * (2 + 10) * 4
    df = A.registered(spark).read.format("tessella_cube").load(path).where("variable IN (3, 9) AND t >= 90 AND site_id < 10 AND z > 0")
    got = {(r.site_id, r.t): r.z for r in df.collect()}
    assert got == {(i, t): float(cube[i, 3, t]) for i in range(10) for t in range(90, 100) if cube[i, 3, t] > 0}
    assert "PythonFilters" in df._jdf.queryExecution().executedPlan().toString() or len(got)
    assert df.where("t < 5").count() == 0


def test_only_attempts_that_count_leave_files(tmp_path):
    """A task that failed once, and one that ran twice; then a job that fails."""
    rows = lambda seed: iter([{"seed": seed, "span": 0, "block": 0, "model": "m", "t": t, "site_id": 1, "y_true": 1.0, "y_pred": 2.0} for t in range(3)])

    def broken():
        yield from rows(1)
        raise RuntimeError("lost")

    writer = A.ArchiveWriter(str(tmp_path / "a"), {})
    with pytest.raises(RuntimeError):
        writer.write(broken())
    first, again, other = writer.write(rows(1)), writer.write(rows(1)), writer.write(rows(2))
    assert first.files != again.files
    writer.commit([again, None, other])
    assert sorted(f.name for f in (tmp_path / "a").iterdir()) == ["_SUCCESS", "seed_1_0_0.npz", "seed_2_0_0.npz"]
    failed = A.ArchiveWriter(str(tmp_path / "b"), {})
    failed.abort([failed.write(rows(1))])
    assert not list((tmp_path / "b").iterdir())


def test_annotation_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image_id,width,bbox\na.jpg,3,"[1, 2, 3, 4]"\n')
    (tmp_path / "b.csv").write_text("image_name,BoxesString,domain\nb.png,0 0 1 1;2 2 3 3,x\n")
    (tmp_path / "c.csv").write_text("name\nx\n")
    assert tuple(T.read_annotations(spark, str(tmp_path / "a.csv")).first()) == ("a", "[1, 2, 3, 4]")
    assert tuple(T.read_annotations(spark, str(tmp_path / "b.csv")).first()) == ("b", "0 0 1 1;2 2 3 3")
    with pytest.raises(ValueError):
        T.read_annotations(spark, str(tmp_path / "c.csv"))


def test_results_with_prefix_and_missing(spark, tmp_path):
    head = "experiment,seed,model,split,metric,value\n"
    (tmp_path / "one.csv").write_text(head + "x,1,m,test,rmse,0.5\n")
    (tmp_path / "fast_two.csv").write_text(head + "x,2,m,test,rmse,0.25\n")
    df, missing = T.read_results(spark, str(tmp_path), ["one", "two", "three"], ["", "fast_"])
    assert missing == ["three"] and sorted((r.experiment, r.value) for r in df.collect()) == [("fast_two", 0.25), ("one", 0.5)]


def test_archives(spark, tmp_path):
    y = np.arange(6.0).reshape(2, 3)
    np.savez(tmp_path / "seed_7.npz", seed=7, y_true=y, first=y + 1, second=y - 1)
    rows = T.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {(r.seed, r.model, r.y_pred - r.y_true) for r in rows} == {(7, "first", 1.0), (7, "second", -1.0)}


def test_archives_in_parts(spark, tmp_path):
    rows = [(7 + s % 2, m, s, t, float(t + s), None if (s, t) == (3, 5) else float(t - s)) for m in ("a", "b") for s in range(6) for t in range(9) if (s, t) != (4, 4)]
    df = spark.createDataFrame(rows, "seed long, model string, site_id long, t long, y_true double, y_pred double")
    for times, sites in ((256, 1024), (4, 2)):
        folder = str(tmp_path / f"a{times}")
        T.write_archives(df, folder, times, sites)
        files = [f.name for f in (tmp_path / f"a{times}").iterdir() if not f.name.startswith(".")]
        assert "_SUCCESS" in files and (len(files) == 3 if times == 256 else len(files) > 7)
        got = T.read_archives(spark, folder).where("y_true IS NOT NULL").collect()
        assert sorted(map(tuple, got), key=lambda r: r[:5]) == sorted(rows, key=lambda r: r[:5])


def test_writers(spark, tmp_path):
    empty = spark.createDataFrame([], T.RESULTS)
    assert not T.write_results(empty, str(tmp_path / "none")) and not (tmp_path / "none").exists()
    a, b = spark.createDataFrame([("f", 1.0)], "function string, wall_time_s double"), spark.createDataFrame([("g", 2.0, "x")], "function string, wall_time_s double, model string")
    T.write_timings([a, b], str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["function", "wall_time_s", "model"]
    (tmp_path / "e.csv").write_text("component,eigenvalue,cumulative_explained_variance\n1,2.5,0.9\n")
    assert T.read_eigenvalues(spark, str(tmp_path / "e.csv")).first().eigenvalue == 2.5


def test_cache_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert T.cached(spark, str(tmp_path), {"b": 1, "a": "x"}, compute).count() == 3
    assert calls == [1]
