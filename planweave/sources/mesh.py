"""Binary glTF files written through Spark's data source interface, and read back."""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from planweave.functions.geometry import bound

# Fixed values of the file format: marks of the file and its two parts, numbers of the kinds of values and of buffers.
MAGIC, JSON_PART, BINARY_PART, FLOAT, UNSIGNED, VERTICES, INDICES = 0x46546C67, 0x4E4F534A, 0x004E4942, 5126, 5125, 34962, 34963
MESH = "file string, name string, vertices array<array<double>>, faces array<array<int>>, rgba array<int>"
#: A mesh as its file holds it: ``body`` is its points, then the corners of its triangles.
PACKED = "file string, name string, n_vertices int, n_faces int, body binary, rgba array<int>"
#: What ``mesh_sizes`` reads of a file's description.
SIZES = "asset struct<version:string>, meshes array<struct<name:string,primitives:array<struct<attributes:struct<POSITION:int>,indices:int>>>>, accessors array<struct<count:int>>"


def glb(meshes: list[tuple]) -> bytes:
    """A file of meshes (name, vertices, faces, rgba or null): each a node with its own buffers and, with a colour, a material."""
    points = [np.array(m[1], "<f4").reshape(-1, 3) for m in meshes]
    corners = [np.array(m[2], "<u4").reshape(-1, 3) for m in meshes]
    body = b"".join(v.tobytes() for pair in zip(points, corners) for v in pair)
    return b"".join(packed_glb([m[0] for m in meshes], np.array([len(p) for p in points], int), np.array([len(c) for c in corners], int), body, [m[3] for m in meshes]))


def packed_glb(names: list[str | None], n_vertices: np.ndarray, n_faces: np.ndarray, body: bytes, colors: list[list[int] | None]) -> list[bytes]:
    """The parts of a file whose meshes' points and corners follow each other in ``body``."""
    ends = np.cumsum(n_vertices + n_faces)
    starts = ends - n_vertices - n_faces  # in threes of values, as are all lengths
    # least and largest values of each mesh's points; the corners between two meshes' points are a stretch that is left out
    drawn = np.flatnonzero(n_vertices)
    threes = np.concatenate([np.frombuffer(body, "<f4").reshape(-1, 3), np.zeros((1, 3), "<f4")])
    edges = np.stack([starts[drawn], starts[drawn] + n_vertices[drawn]], 1).reshape(-1)
    least, most = ((f.reduceat(threes, edges)[::2] if len(edges) else threes[:0]) for f in (np.minimum, np.maximum))
    # finite numbers are written alike by both
    listed = str if np.isfinite(least).all() and np.isfinite(most).all() else json.dumps
    bounds = [""] * len(names)
    for mesh, low, high in zip(drawn.tolist(), least.tolist(), most.tolist()):
        bounds[mesh] = f', "min": {listed(low)}, "max": {listed(high)}'

    nodes, meshes, accessors, views, materials, colored = [], [], [], [], [], {}
    for number, (name, start, points, faces, box, rgba) in enumerate(zip(names, starts.tolist(), n_vertices.tolist(), n_faces.tolist(), bounds, colors)):
        a, b, name = 2 * number, 2 * number + 1, json.dumps(name)
        views.append(f'{{"buffer": 0, "byteOffset": {12 * start}, "byteLength": {12 * points}, "target": {VERTICES}}}, {{"buffer": 0, "byteOffset": {12 * (start + points)}, "byteLength": {12 * faces}, "target": {INDICES}}}')
        accessors.append(f'{{"bufferView": {a}, "componentType": {FLOAT}, "count": {points}, "type": "VEC3"{box}}}, {{"bufferView": {b}, "componentType": {UNSIGNED}, "count": {3 * faces}, "type": "SCALAR"}}')
        material = ""
        if rgba:
            material = f', "material": {len(materials)}'
            color = tuple(rgba)
            if color not in colored:
                colored[color] = json.dumps({"pbrMetallicRoughness": {"baseColorFactor": [c / 255 for c in color]}, "alphaMode": "BLEND" if color[3] < 255 else "OPAQUE"})
            materials.append(colored[color])
        meshes.append(f'{{"name": {name}, "primitives": [{{"attributes": {{"POSITION": {a}}}, "indices": {b}{material}}}]}}')
        nodes.append(f'{{"name": {name}, "mesh": {number}}}')
    lists = {"nodes": nodes, "meshes": meshes, "accessors": accessors, "bufferViews": views, "materials": materials}
    filled = "".join(f', "{k}": [{", ".join(v)}]' for k, v in lists.items() if v)
    text = f'{{"asset": {{"version": "2.0"}}, "scene": 0, "scenes": [{{"nodes": {list(range(len(names)))}}}]{filled}, "buffers": [{{"byteLength": {len(body)}}}]}}'.encode()
    text += b" " * (-len(text) % 4)
    return [struct.pack("<III", MAGIC, 2, 28 + len(text) + len(body)) + struct.pack("<II", len(text), JSON_PART), text, struct.pack("<II", len(body), BINARY_PART), body]


def _threes(lists: pa.Array, kind: str, what: str) -> tuple[np.ndarray, np.ndarray]:
    """How many threes of values each mesh has, and all of them below each other."""
    inner = lists.flatten()
    if lists.null_count or inner.null_count or not np.all(inner.value_lengths().to_numpy(zero_copy_only=False) == 3):
        raise ValueError(f"{what} are no lists of three values each")
    values = inner.flatten()
    if kind == "<u4" and (values.null_count or np.any(values.to_numpy(zero_copy_only=False) < 0)):
        raise ValueError(f"{what} hold no point's number")
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), values.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, 3)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``MESH`` as rows of ``PACKED``, all meshes of a batch at once."""
    for batch in batches:
        n_vertices, points = _threes(batch.column("vertices"), "<f4", "vertices")
        n_faces, corners = _threes(batch.column("faces"), "<u4", "faces")
        ends = np.cumsum(n_vertices + n_faces)
        starts = ends - n_vertices - n_faces
        body = np.empty((len(points) + len(corners), 3), "<u4")
        body[np.arange(len(points)) + np.repeat(starts - np.cumsum(n_vertices) + n_vertices, n_vertices)] = points.view("<u4")
        body[np.arange(len(corners)) + np.repeat(ends - np.cumsum(n_faces), n_faces)] = corners
        offsets = 12 * np.concatenate([[0], ends]).astype(np.int64)
        bodies = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("name"), pa.array(n_vertices, pa.int32()), pa.array(n_faces, pa.int32()), bodies, batch.column("rgba")], names=["file", "name", "n_vertices", "n_faces", "body", "rgba"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[bytes]]]:
    """The files of rows of ``PACKED`` that are sorted by file; a file's rows may stand in several batches."""

    def stretches() -> Iterator[tuple[str | None, pa.RecordBatch]]:
        for batch in batches:
            at = 0
            for file, rows in groupby(batch.column(0).to_pylist()):
                size = sum(1 for _ in rows)
                yield file, batch.slice(at, size)
                at += size

    for file, parts in groupby(stretches(), key=lambda s: s[0]):
        rows = pa.Table.from_batches([part for _, part in parts]).combine_chunks()
        # the bodies of rows in one array follow each other
        bodies = pa.concat_arrays([c.cast(pa.large_binary()) for c in rows.column(4).chunks])
        offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
        body = memoryview(bodies.buffers()[2])[offsets[0] : offsets[-1]] if bodies.buffers()[2] else b""
        yield file, packed_glb(rows.column(1).to_pylist(), *(rows.column(i).to_numpy().astype(np.int64) for i in (2, 3)), body, rows.column(5).to_pylist())


def safe(name: str | None) -> str:
    """A file name of common signs that readers don't take for a hidden file's."""
    plain = re.sub(r"[^A-Za-z0-9._-]", "_", name or "")
    return plain if plain[:1].isalnum() else f"mesh{plain}"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written aside."""

    folder: str
    names: list[str]


class MeshWriter(DataSourceWriter):
    """Tasks write files aside, each attempt in a folder of its own; the commit moves those of the tasks that count into place, an abort deletes all."""

    def __init__(self, path: str) -> None:
        self.path, self.aside = path, f"_aside-{uuid.uuid4().hex}"

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")

    def write(self, iterator: Iterator) -> Written:
        return self._written((file, [glb([(r["name"], r["vertices"], r["faces"], r["rgba"]) for r in rows])]) for file, rows in groupby(iterator, key=lambda r: r["file"]))

    def _written(self, contents: Iterable[tuple[str | None, list[bytes]]]) -> Written:
        files, root = self._files()
        folder, names = f"{self.aside}/{uuid.uuid4().hex}", []
        for file, parts in contents:
            if not names:
                files.create_dir(f"{root}/{folder}", recursive=True)
            names.append(f"{safe(file)}.glb")
            with files.open_output_stream(f"{root}/{folder}/{names[-1]}") as out:
                for part in parts:
                    out.write(part)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._files()
        for message in filter(None, messages):
            for name in message.names:
                files.move(f"{root}/{message.folder}/{name}", f"{root}/{name}")
        self._clean(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._files())

    def _clean(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.aside}")


class PackedWriter(MeshWriter, DataSourceArrowWriter):
    """Takes rows of ``PACKED`` as Arrow batches."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._written(_files(iterator))


class MeshSource(DataSource):
    """Format ``glb`` for rows of ``MESH`` or ``PACKED``: option ``path``, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "glb"

    def schema(self) -> str:
        return MESH

    def writer(self, schema, overwrite: bool) -> MeshWriter:
        return (PackedWriter if "body" in schema.fieldNames() else MeshWriter)(self.options["path"])


def write_meshes(meshes: DataFrame, path: str) -> None:
    """Writes meshes (file, name, vertices, faces, rgba) as one binary glTF file for each ``file``, replacing files of that name.

    A file's meshes meet in one task and are ordered by name; a file is as large as its meshes, and one is held at a time. They are packed
    before they meet, as lists of lists are several times larger. Signs that file names should not hold become underscores, so names differ in others.
    Vertices and faces are lists of three values each; anything else, null and negative numbers of points are errors.
    """
    meshes.sparkSession.dataSource.register(MeshSource)
    rows = meshes.select("file", "name", F.col("vertices").cast("array<array<double>>").alias("vertices"), F.col("faces").cast("array<array<int>>").alias("faces"), F.col("rgba").cast("array<int>").alias("rgba"))
    rows.mapInArrow(_packed, PACKED).repartition("file").sortWithinPartitions("file", "name").write.format("glb").mode("append").save(path)


def mesh_sizes(content: Column) -> Column:
    """array<struct<name, vertices, faces>> of a binary glTF file, null for anything else."""
    number = lambda at: F.conv(F.hex(F.concat(*[F.substring(content, at + i, 1) for i in (3, 2, 1, 0)])), 16, 10).cast("long")
    # what the file says of itself ends before its points, so those are not parsed
    text = F.substring(content, F.lit(21), number(13).cast("int")).cast("string")

    def sizes(doc: Column) -> Column:
        count = lambda i: F.get(doc["accessors"], i)["count"]

        def size(mesh: Column) -> Column:
            first = F.get(mesh["primitives"], 0)
            return F.struct(mesh["name"].alias("name"), count(first["attributes"]["POSITION"]).alias("vertices"), (count(first["indices"]) / 3).cast("int").alias("faces"))

        none = F.array().cast("array<struct<name:string,vertices:int,faces:int>>")
        return F.when(doc["asset"].isNotNull(), F.coalesce(F.transform(doc["meshes"], size), none))

    return F.when((number(1) == MAGIC) & (number(13) + 20 <= F.length(content)), bound(F.from_json(text, SIZES), sizes))
