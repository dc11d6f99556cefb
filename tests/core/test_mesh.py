"""Binary glTF files: what they hold, and that failed jobs leave nothing."""

import json
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planweave.sources import blobs, mesh
from planweave.sources.mesh import MESH, MeshWriter, glb, mesh_sizes, write_meshes

ONE = ([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.5]], [[0, 1, 2]])


def test_a_file_holds_its_points_and_triangles():
    data = glb([("a", *ONE, [255, 0, 0, 51]), ("b", *ONE, None), ("c", [], [], None)])
    magic, version, length, size, kind = struct.unpack("<IIIII", data[:20])
    assert (magic, version, length, kind) == (0x46546C67, 2, len(data), 0x4E4F534A) and size % 4 == 0
    doc = json.loads(data[20 : 20 + size])
    body = data[28 + size :]
    assert doc["buffers"] == [{"byteLength": len(body)}] and [n["name"] for n in doc["nodes"]] == ["a", "b", "c"]
    view = doc["bufferViews"][2]
    assert np.frombuffer(body, "<f4", 9, view["byteOffset"]).reshape(3, 3).tolist() == ONE[0]
    assert doc["accessors"][0]["max"] == [1.0, 2.0, 0.5] and doc["materials"][0]["pbrMetallicRoughness"]["baseColorFactor"] == [1.0, 0.0, 0.0, 0.2]
    assert "material" not in doc["meshes"][1]["primitives"][0]


def test_files_are_written_and_read_back(spark, tmp_path):
    rows = [(f"p{i % 3}/x", f"m{i}", *ONE, None) for i in range(7)] + [(None, "alone", *ONE, [1, 2, 3, 4])]
    for _ in range(2):  # again: files are replaced
        write_meshes(spark.createDataFrame(rows, MESH).repartition(4), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["mesh.glb", "p0_x.glb", "p1_x.glb", "p2_x.glb"]
    read = blobs.blobs(spark, str(tmp_path / "out"), "*.glb").select(F.explode(mesh_sizes(F.col("content"))).alias("m")).select("m.*")
    assert sorted(map(tuple, read.collect())) == sorted([(f"m{i}", 3, 1) for i in range(7)] + [("alone", 3, 1)])
    assert spark.createDataFrame([(b"no mesh",), (None,)], "content binary").select(mesh_sizes(F.col("content")).alias("m")).filter("m IS NOT NULL").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "good", *ONE, None), ("b", "bad", [[0.0]], [[0]], None)], MESH)
    with pytest.raises(Exception):  # noqa: B017
        write_meshes(rows, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_only_attempts_that_count_are_moved(tmp_path):
    writer = MeshWriter(str(tmp_path))
    row = lambda name: {"file": "f", "name": name, "vertices": ONE[0], "faces": ONE[1], "rgba": None}
    writer.write(iter([row("lost")]))
    kept = writer.write(iter([row("kept")]))
    writer.commit([kept, None])
    assert os.listdir(tmp_path) == ["f.glb"] and b"kept" in (tmp_path / "f.glb").read_bytes()


def plain_glb(meshes):
    """The file made of dictionaries, a mesh at a time."""
    parts, size = [], 0
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(meshes)))}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": [], "materials": [], "buffers": []}
    for number, (name, vertices, faces, rgba) in enumerate(meshes):
        points, corners = np.array(vertices, "<f4").reshape(-1, 3), np.array(faces, "<u4").reshape(-1)
        for values, target in ((points, 34962), (corners, 34963)):
            doc["bufferViews"].append({"buffer": 0, "byteOffset": size, "byteLength": values.nbytes, "target": target})
            parts.append(values.tobytes())
            size += values.nbytes
        box = {"min": points.min(0).tolist(), "max": points.max(0).tolist()} if len(points) else {}
        doc["accessors"] += [{"bufferView": 2 * number, "componentType": 5126, "count": len(points), "type": "VEC3", **box}, {"bufferView": 2 * number + 1, "componentType": 5125, "count": len(corners), "type": "SCALAR"}]
        primitive = {"attributes": {"POSITION": 2 * number}, "indices": 2 * number + 1}
        if rgba:
            primitive["material"] = len(doc["materials"])
            doc["materials"].append({"pbrMetallicRoughness": {"baseColorFactor": [c / 255 for c in rgba]}, "alphaMode": "BLEND" if rgba[3] < 255 else "OPAQUE"})
        doc["meshes"].append({"name": name, "primitives": [primitive]})
        doc["nodes"].append({"name": name, "mesh": number})
    doc["buffers"] = [{"byteLength": size}]
    text = json.dumps({k: v for k, v in doc.items() if v != []}).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(parts)
    return struct.pack("<IIIII", 0x46546C67, 2, 28 + len(text) + len(body), len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body


def random_meshes(seed):
    r = random.Random(seed)
    number = lambda: r.choice([0.0, -0.0, 0.1, 1e-9, 1e20, r.uniform(-9, 9)] + [float("nan"), float("inf")] * (seed % 2))
    for i in range(r.randrange(1, 40)):
        n = r.choice([0, 0, 1, 3, 8])
        vertices, faces = [[number() for _ in range(3)] for _ in range(n)], [[r.randrange(n) for _ in range(3)] for _ in range(r.randrange(5) if n else 0)]
        yield r.choice([None, f"m{i}", f'"\\ü\n{i}']), vertices, faces, r.choice([None, [], [1, 2, 3, 4], [255, 0, 9, 255]])


@pytest.mark.parametrize("seed", range(12))
def test_packed_batches_give_the_plain_files(seed):
    files = {name: list(random_meshes(seed * 10 + k)) for k, name in enumerate(("a", "b", None))}
    files["empty"] = [("none", [], [], None)]
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("vertices", pa.list_(pa.list_(pa.float64()))), ("faces", pa.list_(pa.list_(pa.int32()))), ("rgba", pa.list_(pa.int32()))])
    rows = [dict(zip(schema.names, (file, *m))) for file, meshes in files.items() for m in meshes]
    cut = random.Random(seed).randrange(1, 9)  # files end within batches and go on in the next
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=cut)
    written = [(file, b"".join(parts)) for file, parts in mesh._files(mesh._packed(iter(batches)))]
    assert written == [(file, plain_glb(meshes)) for file, meshes in files.items()]
    assert all(glb(meshes) == plain_glb(meshes) for meshes in files.values()) and glb([]) == plain_glb([])


def test_meshes_meet_packed_and_their_files_are_the_plain_ones(spark, tmp_path):
    rows = [(f"f{i % 2}", f"m{i:02}", [[float(i), 0.5, 0.0]] * (i + 1), [[0, i, i]] * i, [1, 2, 3, i] if i % 3 else None) for i in range(23)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        write_meshes(spark.createDataFrame(rows, MESH).repartition(4), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((tmp_path / "out" / f"f{k}.glb").read_bytes() == plain_glb([r[1:] for r in rows if r[0] == f"f{k}"]) for k in range(2))
    # lists of lists don't reach the tasks that write
    assert issubclass(mesh.PackedWriter, mesh.DataSourceArrowWriter) and "array<array" not in mesh.PACKED


@pytest.mark.parametrize("vertices, faces", [([[0.0, 1.0]], []), ([[0.0] * 6], []), (None, []), ([None], []), (ONE[0], [[0, 1]]), (ONE[0], [[0, 1, -1]]), (ONE[0], [[0, 1, None]]), (ONE[0], None)])
def test_other_lists_are_errors(vertices, faces):
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array(["m"]), pa.array([vertices], pa.list_(pa.list_(pa.float64()))), pa.array([faces], pa.list_(pa.list_(pa.int32()))), pa.array([None], pa.list_(pa.int32()))], names=["file", "name", "vertices", "faces", "rgba"])
    with pytest.raises(ValueError):
        list(mesh._packed(iter([batch])))


def test_sizes_are_read_by_spark_and_broken_files_are_null(spark):
    good = glb([("ä", *ONE, None), ("b", [], [], [1, 2, 3, 4])])
    text = b'{"asset": {"version": "2.0"}}  '
    bare = struct.pack("<IIIII", mesh.MAGIC, 2, 20 + len(text), len(text), mesh.JSON_PART) + text
    broken = good[:20] + b"}" + good[21:]
    contents = [good, bare, broken, good[:12] + b"\xff" * 4 + good[16:], good[:60], good[:10], b"", b"glTF", b"no mesh at all, but long enough", None]
    read = spark.createDataFrame(list(enumerate(contents)), "i int, content binary").select("i", mesh_sizes(F.col("content")).alias("m"))
    assert [r.m and [tuple(s) for s in r.m] for r in read.orderBy("i").collect()] == [[("ä", 3, 1), ("b", 0, 0)], [], *[None] * 8]
    assert "Python" not in read._jdf.queryExecution().executedPlan().toString()
