"""Array files as Spark data sources: cubes of (site, variable, time), and archives of predictions.

Files are reached through Arrow's file systems, so any storage that they know will do. A cube's partitions
are ranges of sites, and a task reads the byte ranges of the variables and times that filters leave. Writers
commit in two phases: tasks put their files into a staging folder of the job, and the driver moves those of
the attempts that count to their names; a failed or doubled task leaves nothing, and a job that fails removes
its staging folder."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Part:
    """One array file: its first site, shape, element type and where its numbers start."""

    path: str
    first: int
    shape: tuple[int, ...]
    kind: str
    offset: int


def part_of(store: fs.FileSystem, path: str, first: int = 0) -> Part:
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(16384))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran:
        raise ValueError("arrays are in row order")
    return Part(path, first, shape, kind.str, head.tell())


def parts_of(path: str) -> list[Part]:
    """Of an array file, or of a folder of them with ranges of sites."""
    store, plain = located(path)
    if store.get_file_info(plain).type == fs.FileType.File:
        return [part_of(store, plain)]
    found = [i.path for i in store.get_file_info(fs.FileSelector(plain)) if re.search(r"sites_\d+\.npy$", i.path)]
    if not found:
        raise ValueError(f"there is no array in {path}")
    return [part_of(store, p, int(re.search(r"(\d+)\.npy$", p).group(1))) for p in sorted(found)]


@dataclass
class Sites(InputPartition):
    part: Part
    first: int
    end: int


class CubeReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.parts = path, parts_of(path)
        if any(len(p.shape) != 3 for p in self.parts):
            raise ValueError("a cube has three axes: site, variable, time")
        self.lat, self.lon, self.per_task = int(options.get("lat", 0)), int(options.get("lon", 1)), int(options.get("sites", 1024))
        last = self.parts[-1]
        self.sites, self.variables, self.times = (0, last.first + last.shape[0]), list(range(last.shape[1])), (0, last.shape[2])

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on variable, t and site_id narrow what is read; all others are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "variable" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.variables = [v for v in self.variables if v in wanted]
            elif name in ("t", "site_id") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low, high = self.times if name == "t" else self.sites
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value + (not isinstance(f, LessThan)))
                if name == "t":
                    self.times = (low, high)
                else:
                    self.sites = (low, high)
            else:
                yield f

    def partitions(self) -> list[Sites]:
        out = []
        for p in self.parts:
            low, high = max(self.sites[0], p.first), min(self.sites[1], p.first + p.shape[0])
            out += [Sites(p, s, min(high, s + self.per_task)) for s in range(low, high, self.per_task)]
        return out if self.variables and self.times[0] < self.times[1] else []

    def planned(self) -> int:
        """Bytes that the partitions will read."""
        return sum((p.end - p.first) * (2 + len(self.variables) * (self.times[1] - self.times[0])) * np.dtype(p.part.kind).itemsize for p in self.partitions())

    def read(self, own: Sites | None) -> Iterator[pa.RecordBatch]:
        if own is None:  # nothing is left to read
            return
        store, _ = located(self.path)
        part, kind = own.part, np.dtype(own.part.kind)
        first, end = self.times
        with store.open_input_file(part.path) as f:

            def numbers(site: int, variable: int, start: int, n: int) -> np.ndarray:
                place = ((site - part.first) * part.shape[1] + variable) * part.shape[2] + start
                f.seek(part.offset + place * kind.itemsize)
                return np.frombuffer(f.read(n * kind.itemsize), kind).astype(float)

            for site in range(own.first, own.end):
                x, y = numbers(site, self.lon, 0, 1)[0], numbers(site, self.lat, 0, 1)[0]
                for v in self.variables:
                    z = numbers(site, v, first, end - first)
                    t = np.flatnonzero(np.isfinite(z))
                    fill = lambda value, kind: pa.array(np.full(len(t), value, kind))
                    yield pa.RecordBatch.from_arrays([fill(site, np.int64), fill(x, float), fill(y, float), fill(v, np.int32), pa.array(t + first), pa.array(z[t])], names=["site_id", "x", "y", "variable", "t", "z"])


@dataclass
class Staged(WriterCommitMessage):
    """Staged files with their names, and how many sites or rows they hold."""

    files: list[tuple[str, str]]
    held: int


class StagedWriter(DataSourceWriter):
    """Two-phase commit of whole files; ``made`` gives the name, the content and the count of each from the rows of a
    task, which come in groups."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options, self.job = path, dict(options), uuid.uuid4().hex

    def made(self, rows: Iterator) -> Iterator[tuple[str, bytes, int]]:
        raise NotImplementedError

    def complete(self, held: int) -> None:
        """Called before anything is moved; an error fails the job."""

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, plain = located(self.path)
        return store, plain, f"{plain}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        store, _, staging = self._staging()
        out = Staged([], 0)
        for name, content, held in self.made(rows):
            store.create_dir(staging, recursive=True)
            place = f"{staging}/{uuid.uuid4().hex}"
            with store.open_output_stream(place) as f:
                f.write(content)
            out.files.append((place, name))
            out.held += held
        return out

    def commit(self, messages: list) -> None:
        store, plain, staging = self._staging()
        done = [m for m in messages if m is not None]
        try:
            self.complete(sum(m.held for m in done))
        except ValueError:
            self.abort(messages)
            raise
        store.create_dir(plain, recursive=True)
        for place, name in (f for m in done for f in m.files):
            store.move(place, f"{plain}/{name}")
        self.abort(messages)
        with store.open_output_stream(f"{plain}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def _content(save, *args, **named) -> bytes:
    out = io.BytesIO()
    save(out, *args, **named)
    return out.getvalue()


class CubeWriter(StagedWriter):
    """Rows (part, i, variable, t, value), sorted by part; cells that are not given are NaN, and every site needs one."""

    def made(self, rows: Iterator) -> Iterator[tuple[str, bytes, int]]:
        shape, size = [int(n) for n in self.options["shape"].split(",")], int(self.options["sites"])
        for part, own in groupby(rows, key=lambda r: r["part"]):
            out = np.full((min(size, shape[0] - part * size), *shape[1:]), np.nan)
            seen = set()
            for r in own:
                out[r["i"] - part * size, r["variable"], r["t"]] = r["value"]
                seen.add(r["i"])
            yield f"sites_{part * size:012d}.npy", _content(np.save, out), len(seen)

    def complete(self, held: int) -> None:
        if held != int(self.options["shape"].split(",")[0]):
            raise ValueError("a site has no cell")


class ArchiveWriter(StagedWriter):
    """Rows (seed, span, block, model, site_id, t, y_true, y_pred), sorted by the first three: one archive for each."""

    def made(self, rows: Iterator) -> Iterator[tuple[str, bytes, int]]:
        for (seed, span, block), own in groupby(rows, key=lambda r: (r["seed"], r["span"], r["block"])):
            cells = [(r["model"], r["t"], r["site_id"], r["y_true"], r["y_pred"]) for r in own]
            models, t, site, truth, pred = zip(*cells)
            (t, row), (site, column) = (np.unique(np.array(x), return_inverse=True) for x in (t, site))
            number = lambda x: np.array([np.nan if v is None else v for v in x], float)
            truth, pred, models = number(truth), number(pred), np.array(models)

            def matrix(at: np.ndarray, values: np.ndarray) -> np.ndarray:
                out = np.full((len(t), len(site)), np.nan)
                out[row[at], column[at]] = values[at]
                return out

            named = {str(m): matrix(models == m, pred) for m in sorted(set(models))}
            yield f"seed_{seed}_{span}_{block}.npz", _content(np.savez, seed=seed, t=t, site_id=site, y_true=matrix(np.ones(len(row), bool), truth), **named), len(cells)


class CubeSource(DataSource):
    """Reads (site_id, x, y, variable, t, z) and writes (part, i, variable, t, value)."""

    @classmethod
    def name(cls) -> str:
        return "tessella_cube"

    def schema(self) -> str:
        return "site_id long, x double, y double, variable int, t long, z double"

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> CubeWriter:
        return CubeWriter(self.options["path"], self.options)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_archives"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CubeSource, ArchiveSource):
        spark.dataSource.register(source)
    return spark
