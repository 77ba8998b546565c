import base64
import struct

import numpy as np
import pytest

from swarmframe import sources as S
from swarmframe.operators import calibration as C
from swarmframe.operators import dataset as D

K = "1000 0 960 0 1010 540 0 0 1"


def intr_xml(k=K, dist="0.1 0.2 0.3"):
    out = "<?xml version=\"1.0\"?>\n<opencv_storage>\n"
    if k is not None:
        out += f"<camera_matrix type_id=\"opencv-matrix\"><rows>3</rows><cols>3</cols><dt>d</dt><data>\n  {k}\n</data></camera_matrix>\n"
    if dist is not None:
        out += f"<distortion_coefficients><rows>1</rows><data>{dist}</data></distortion_coefficients>\n"
    return out + "</opencv_storage>"


def extr_xml(r=(0.0, 0.0, 0.5), t=(1.0, 2.0, 3.0), kind="binary", head=b"head"):
    def node(name, v):
        if v is None:
            return ""
        return (f"<{name}><rows>3</rows><dt>d</dt><data type_id=\"{kind}\">\n"
                f"{base64.b64encode(head + struct.pack('<3d', *v)).decode()}\n</data></{name}>")
    return f"<opencv_storage>{node('rvec', r)}{node('tvec', t)}</opencv_storage>"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    for folder in ("calibrations/intrinsic", "calibrations/extrinsic", "image_subsets/D1", "image_subsets/D2"):
        (base / folder).mkdir(parents=True)
    intr = {(1, 0): intr_xml(), (2, 0): intr_xml(k="2000 0 1 0 2 3 0 0 1"), (1, 1): intr_xml(k=None), (1, 2): intr_xml(dist=None),
            (1, 3): "<opencv_storage><broken>", (2, 1): intr_xml(k="1 2 3"), (1, 4): intr_xml(), (1, 5): intr_xml(),
            (1, 6): intr_xml(), (2, 3): intr_xml()}
    extr = {(1, 0): extr_xml(), (2, 0): extr_xml(r=(0.0, 0.0, 0.0)), (1, 1): extr_xml(), (1, 2): extr_xml(head=b""),
            (1, 3): extr_xml(), (2, 1): extr_xml(), (1, 4): extr_xml(kind="text"), (1, 5): extr_xml(t=None),
            (2, 2): extr_xml(), (2, 3): extr_xml(r=None)}
    for (d, f), text in intr.items():
        (base / f"calibrations/intrinsic/intr_Drone{d}_{f:04d}.xml").write_text(text)
    for (d, f), text in extr.items():
        (base / f"calibrations/extrinsic/extr_Drone{d}_{f:04d}.xml").write_text(text)
    for d, f in {*intr, *extr, (2, 4)} - {(2, 3)}:
        (base / f"image_subsets/D{d}/{f:04d}.png").write_bytes(b"\x89PNG" if (d, f) != (1, 2) else b"")
    (base / "image_subsets/D1/notes.png").write_bytes(b"x")
    return str(base)


def test_scans(spark, root):
    frames = S.scan_frames(spark, root)
    # an empty file is no frame, as for an image reader
    assert "content" not in frames.columns and frames.count() == 10
    assert S.read_frames(spark, root).filter("drone_id = 1 AND frame_num = 0").first().content == b"\x89PNG"
    intr = {(r.drone_id, r.frame_num): r for r in S.scan_intrinsics(spark, root).collect()}
    assert intr[(1, 0)].k_text == K and intr[(1, 0)].dist_text == "0.1 0.2 0.3" and intr[(1, 0)].error_kind is None
    assert intr[(1, 1)].k_text is None and intr[(1, 2)].dist_text is None
    assert intr[(1, 3)].error_kind == "corrupt"
    extr = {(r.drone_id, r.frame_num): r for r in S.scan_extrinsics(spark, root).collect()}
    assert struct.unpack("<3d", bytes(extr[(1, 0)].tvec)) == (1.0, 2.0, 3.0)
    assert struct.unpack("<3d", bytes(extr[(1, 2)].rvec)) == (0.0, 0.0, 0.5)
    assert extr[(1, 4)].error_kind == "rvec_not_binary" and extr[(1, 5)].error_kind == "tvec_not_found"
    assert extr[(2, 3)].error_kind == "rvec_not_found" and extr[(1, 4)].tvec is None


def test_calibration_join(spark, root):
    calib = C.load_calibration(S.scan_intrinsics(spark, root), S.scan_extrinsics(spark, root))
    rows = {(r.drone_id, r.frame_num): r for r in calib.collect()}
    assert set(rows) == {(1, 0), (2, 0), (1, 2)}
    c, s = np.cos(0.5), np.sin(0.5)
    assert np.allclose(rows[(1, 0)].R, [[c, -s, 0], [s, c, 0], [0, 0, 1]], atol=1e-6)
    assert rows[(2, 0)].R == [[1, 0, 0], [0, 1, 0], [0, 0, 1]] and rows[(1, 2)].dist == [0.0] * 5
    seen = C.compare_calibration(calib, 0, [3, 2, 1]).collect()
    assert [(r.drone_id, r.loaded, r.fx, r.n_loaded, r.n_requested) for r in seen] == [
        (1, True, 1000.0, 2, 3), (2, True, 2000.0, 2, 3), (3, False, None, 2, 3)]


def test_manifest(spark, root):
    rows = C.frame_manifest(S.scan_frames(spark, root), S.scan_extrinsics(spark, root), S.scan_intrinsics(spark, root),
                            n_drones=2, n_frames=8)
    got = {(r.drone_id, r.frame_num): r.status for r in rows.collect()}
    assert len(got) == 16
    want = {(1, 0): "ok", (2, 0): "ok", (1, 1): "ok", (1, 2): "frame_missing", (1, 3): "intrinsic_error", (2, 1): "ok",
            (1, 4): "extrinsic_error", (1, 5): "extrinsic_error", (1, 6): "extrinsic_missing", (2, 2): "intrinsic_missing",
            (2, 3): "frame_missing", (2, 4): "extrinsic_missing", (2, 7): "frame_missing"}
    assert {k: got[k] for k in want} == want


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name in ("D1/0000.png", "D1/0001.png", "D1/0001.jpg", "D7/0000.jpg", "D8/a b.png", "D9/0000.png"):
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(b"x")
    for name in ("D1/labels/0000.txt", "D1/labels/0001.txt", "D7/labels/0000.txt"):
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text("0 .5 .5 .1 .1")
    return str(base)


def test_split(spark, tree, tmp_path):
    images, labels = S.scan_split_images(spark, tree)
    assert images.count() == 6 and labels.count() == 3
    labelled = D.attach_labels(images, labels)
    assert labelled.filter("label_path IS NULL").count() == 2
    counts = {r.folder: r for r in D.split_counts(images).collect()}
    assert counts["D1"].n_images == 3 and counts["D1"].split_images == 3 and not counts["D2"].present and len(counts) == 8
    check = D.verify_dataset(D.with_split(images), D.with_split(labels)).first()
    assert (check.train_images, check.train_labels, check.val_images, check.test_images) == (3, 2, 1, 1)
    assert check.error is None and check.warning == "train image/label mismatch"
    check = D.verify_dataset(D.with_split(images.filter("folder <> 'D7'")), D.with_split(labels)).first()
    assert check.error == "no validation images"
    out = str(tmp_path / "manifest")
    D.write_split(labelled, out)
    D.write_split(labelled, out)
    rows = spark.read.parquet(out).collect()
    assert {(r.split, r.kind, r.dst) for r in rows} == {
        ("train", "image", "images/train/D1_0000.png"), ("train", "image", "images/train/D1_0001.png"),
        ("train", "image", "images/train/D1_0001.jpg"), ("train", "label", "labels/train/D1_0000.txt"),
        ("train", "label", "labels/train/D1_0001.txt"), ("val", "image", "images/val/D7_0000.jpg"),
        ("val", "label", "labels/val/D7_0000.txt"), ("test", "image", "images/test/D8_a b.png")}
    assert len(rows) == 8


def test_prepared_tree(spark, tmp_path):
    for name in ("images/train/D1_0.png", "images/val/D7_0.jpg", "labels/train/D1_0.txt"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("x")
    images, labels = S.scan_split(spark, str(tmp_path))
    check = D.verify_dataset(images, labels).first()
    assert (check.train_images, check.train_labels, check.val_images, check.val_labels) == (1, 1, 1, 0)
    assert check.warning == "val image/label mismatch"


def test_packets_at_rest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = S.scan_packet_files(spark, str(tmp_path)).first()
    assert bytes(row.packet) == b"abc" and row.arrival_ts is not None
    path = str(tmp_path / "table")
    spark.range(3).selectExpr("1L session_id", "id packet_id", "1 port_drone_id", "timestamp'2024-01-01' arrival_ts",
                              "binary('x') packet").write.parquet(path)
    assert S.scan_packets(spark, path).count() == 3


def test_elements_at_any_depth(spark):
    """The first element of a name in the order of the file, and the first data below it, as a descendant search finds them."""
    deep = "<r><a><data>0</data><b><camera_matrix><c><d><data> 1 2 </data></d></c><data>3</data></camera_matrix></b></a><camera_matrix><data>4</data></camera_matrix></r>"
    cases = {
        "deep": (deep, "1 2", None), "no data": ("<r><camera_matrix><rows>3</rows></camera_matrix></r>", None, None),
        "root": ("<camera_matrix><data>1</data></camera_matrix>", None, None), "empty data": ("<r><camera_matrix><data/></camera_matrix></r>", "", None),
        "two roots": ("<r></r><r></r>", None, "corrupt"), "cut off": (deep[:-4], None, "corrupt"), "no file": ("", None, "corrupt"), "null": (None, None, "corrupt"),
        "text behind": (deep + "rest", None, "corrupt"), "comment": ("<r><!-- <camera_matrix> --><x><camera_matrix><data>5</data></camera_matrix></x></r>", "5", None)}
    df = spark.createDataFrame([(n, x) for n, (x, _, _) in cases.items()], "name string, xml string")
    got = {r.name: (r.k_text, r.error_kind) for r in S.parse_intrinsic_xml(df).collect()}
    assert got == {n: (k, e) for n, (_, k, e) in cases.items()}


def test_vectors_at_any_depth(spark):
    flat = extr_xml()
    rvec, tvec = flat[len("<opencv_storage>"):-len("</opencv_storage>")].split("<tvec>")
    deep = f"<o><camera><pose>{rvec}</pose></camera><list><item><tvec>{tvec}</item></list></o>"
    df = spark.createDataFrame([("flat", flat), ("deep", deep), ("damaged", deep[:-9])], "name string, xml string")
    rows = {r.name: r for r in S.parse_extrinsic_xml(df).collect()}
    assert rows["deep"][1:] == rows["flat"][1:] and rows["flat"].error_kind is None and rows["damaged"].error_kind == "corrupt"


def test_written_tree_reads_back(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("D1/0001.png", b"a"), ("D2/0002.png", b"bb"), ("D2/labels/0002.txt", b"x"), (None, b"y"), ("D3/0003.png", None)],
                               "name string, content binary")
    for _ in range(2):  # the same files again
        S.write_tree(df, str(tmp_path / "t"), F.col("name"), F.col("content"))
    assert [(r.drone_id, r.frame_num, r.length) for r in S.scan_frames(spark, str(tmp_path / "t")).orderBy("drone_id").collect()] == [(1, 1, 1), (2, 2, 2)]
    assert (tmp_path / "t" / "D2" / "labels" / "0002.txt").read_bytes() == b"x" and not (tmp_path / "t" / "D3").exists()


def test_many_files_are_few_tasks(spark, tmp_path):
    for name in [f"D{i % 4}/{i:04d}.png" for i in range(1500)] + ["D1/labels/0001.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    frames = S.scan_frames(spark, str(tmp_path))
    # Spark's own splits hold 32 of these files each
    assert frames.count() == 1500 and frames.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    images, labels = S.scan_split_images(spark, str(tmp_path))
    assert images.count() == 1500 and labels.count() == 1
    # folders are listed, not every file by its own name
    listed = images._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths()
    assert listed.size() == 4


def test_only_files_directly_below_the_folders(spark, tmp_path, monkeypatch):
    good = ["D1/1.png", "D1/2.jpg", "D1/labels/1.txt", "Dx y/é.png"]
    for name in [*good, "D1/3.gif", "D1/4.txt", "D1/labels/5.png", "D1/D2/6.png", "D1/D2/labels/7.txt", "E1/8.png", "x/D1/9.png", "D.png", "D1/labels/x/1.txt", "D1/_h.png"]:
        (tmp_path / "D9" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "D9" / name).write_bytes(b"x")
    (tmp_path / "D9/D1/empty.png").write_bytes(b"")
    for root in (f"{tmp_path}/D9", f"file:{tmp_path}/D9/", f"file://{tmp_path}/D9"):
        images, labels = S.scan_split_images(spark, root)
        found = [r.path for df in (images, labels) for r in df.collect()]
        assert sorted(p.split("/D9/")[-1] for p in found) == sorted(good) and all(p.startswith("file:/") for p in found)
