import gzip
import json
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from annotary import schemas
from annotary.checks import CorpusError, TaxonomyConfigError, UnknownClassError, UnknownSourceError
from annotary.operators import coco, records, stats, taxonomy
from annotary.plans import corpus as corpus_plan
from annotary.plans import results
from annotary.session import sized
from annotary.sources import coco as coco_source
from annotary.sources import images as image_source
from annotary.sources import document, listing, run_files, sinks, supervisely, taxonomy_file, via


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = b"".join(b"\0" + bytes(range(256))[: 3 * width % 256].ljust(3 * width, b"\7") for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(width, height, cut=False):
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3, 8, height, width, 1) + b"\x01\x11\x00"
    data = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + frame + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12" * 400
    return data[: len(data) // 2] if cut else data + b"\xff\xd9"


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def by_id(df):
    return {r["image_id"].split("/", 1)[1]: r for r in df.collect()}


def test_image_scan(spark, tmp_path):
    put(tmp_path / "ok.png", png(16, 12))
    put(tmp_path / "cut.png", png(16, 12)[:60])
    put(tmp_path / "ok.jpg", jpeg(20, 10))
    put(tmp_path / "cut.jpg", jpeg(20, 10, cut=True))
    put(tmp_path / "empty.jpg", b"")
    put(tmp_path / "text.png", b"not an image")
    scan = {r["path"].rsplit("/", 1)[1]: r for r in image_source.scan_images(spark, str(tmp_path)).collect()}
    assert {k for k, r in scan.items() if r["readable"]} == {"ok.png", "ok.jpg"}
    assert (scan["ok.png"]["width"], scan["ok.png"]["height"]) == (16, 12)
    assert (scan["ok.jpg"]["width"], scan["ok.jpg"]["height"]) == (20, 10)
    decoded = image_source.scan_images(spark, str(tmp_path), decode=True).filter("readable").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in decoded] == ["ok.png"]


def make_via(root):
    def region(cls, xs, ys):
        return {"all_x": xs, "all_y": ys, "class": cls}

    a, b, c, d = "01012020_172204image853193.jpg", "01012020_172204image999999.jpg", "z1692240140997_deadbeef.jpg", "02022020_080000image1.jpg"
    put(root / "0Train_via_annos.json", {
        a: {"name": a, "regions": [region("mop_lom", [0, 20, 20, 0], [0, 0, 10, 10]), region("tray_son", [5, 5, 5], [1, 2, 2])]},
        b: {"name": b, "regions": [region("rach", [1, 4, 1], [1, 1, 5])]},
        c: {"name": c, "regions": [region("vo_kinh", [2, 8, 8, 2], [2, 2, 6, 6])]},
    })
    put(root / "0Val_via_annos.json", {d: {"name": d, "regions": [region("thung", [0, 6, 3], [0, 0, 9])]}})
    for name, size, folder in ((a, (32, 24), "image/image"), (b, (16, 16), "image/image"), (c, (20, 10), "image/image"), (d, (12, 18), "validation/validation")):
        put(root / folder / name, jpeg(*size))


def test_via_records(spark, tmp_path):
    make_via(tmp_path)
    got = by_id(via.via_records(spark, str(tmp_path)))
    first = got["01012020_172204image853193"]
    assert (first["width"], first["height"], first["n_dropped"]) == (32, 24, 1)
    assert [(i["area"], i["bbox"], i["source_class"]) for i in first["instances"]] == [(200.0, [0, 0, 20, 10], "mop_lom")]
    assert first["group_id"] == got["01012020_172204image999999"]["group_id"] == "vehide/01012020_172204"
    assert got["z1692240140997_deadbeef"]["group_id"] == "vehide/z1692240140997_deadbeef.jpg"
    assert got["02022020_080000image1"]["split_hint"] == "val"
    (tmp_path / "image/image/z1692240140997_deadbeef.jpg").unlink()
    with pytest.raises(CorpusError, match="missing"):
        via.via_records(spark, str(tmp_path))


SQUARE, COLLINEAR = [10, 10, 30, 10, 30, 30, 10, 30], [0, 0, 5, 5, 10, 10]


def make_coco(root, **change):
    names = ["dent", "scratch", "crack", "glass shatter", "lamp broken", "tire flat"]
    cats = [{"id": k, "name": n, "supercategory": "x"} for k, n in enumerate(names, 1)]

    def ann(i, image, cat, seg, **more):
        return {"id": i, "image_id": image, "category_id": cat, "segmentation": seg, "area": 1.0, "iscrowd": 0, **more}

    docs = {
        "train": ([(1, 100, 80), (2, 60, 60)], [ann(3, 2, 3, [SQUARE, COLLINEAR]), ann(1, 1, 2, [SQUARE], **change), ann(2, 1, 1, [COLLINEAR])]),
        "val": ([(3, 40, 40)], [ann(1, 3, 6, [SQUARE])]),
        "test": ([(4, 40, 40), (5, 30, 30)], [ann(1, 4, 4, [SQUARE])]),
    }
    for split, (images, anns) in docs.items():
        put(root / f"{split}.json", {
            "images": [{"id": i, "width": w, "height": h, "file_name": f"{i:06d}.jpg"} for i, w, h in images],
            "annotations": anns, "categories": cats, "info": {}, "licenses": [],
        })
        for i, w, h in images:
            put(root / split / f"{i:06d}.jpg", jpeg(w, h))


def test_coco_records(spark, tmp_path):
    make_coco(tmp_path)
    got = by_id(coco_source.coco_records(spark, str(tmp_path)))
    assert len(got) == 5 and got["000005"]["instances"] == []
    one, two = got["000001"], got["000002"]
    assert [(i["source_class"], i["area"], i["bbox"]) for i in one["instances"]] == [("scratch", 400.0, [10, 10, 20, 20])]
    assert (one["n_degenerate"], one["n_dropped"]) == (1, 1)
    assert [len(i["polygon"]) for i in two["instances"]] == [1] and (two["n_degenerate"], two["n_dropped"]) == (1, 0)
    assert one["group_id"] == one["image_id"] == "cardd/000001" and got["000004"]["split_hint"] == "test"


@pytest.mark.parametrize("change", [{"segmentation": {"counts": "x", "size": [1, 1]}}, {"iscrowd": 1}, {"category_id": 99}])
def test_coco_refuses(spark, tmp_path, change):
    make_coco(tmp_path, **change)
    with pytest.raises(CorpusError):
        coco_source.coco_records(spark, str(tmp_path))


def test_coco_missing_image(spark, tmp_path):
    make_coco(tmp_path)
    (tmp_path / "val/000003.jpg").unlink()
    with pytest.raises(CorpusError, match="missing"):
        coco_source.coco_records(spark, str(tmp_path))


def make_supervisely(root, classes=supervisely.CLASSES, title="Scratch", geometry="polygon"):
    base = root / supervisely.DATASET_DIR
    put(base / "meta.json", {"classes": [{"title": c, "shape": "polygon"} for c in classes]})

    def obj(i, cls, ring, holes=(), kind="polygon"):
        pts = [ring[k : k + 2] for k in range(0, len(ring), 2)]
        return {"id": i, "classTitle": cls, "geometryType": kind, "points": {"exterior": pts, "interior": list(holes)}}

    hole = [[12, 12], [14, 12], [14, 14]]
    put(base / "File1/ann/Car damages 1.png.json", {"size": {"width": 100, "height": 80}, "objects": [
        obj(1, title, SQUARE, kind=geometry), obj(2, "Scratch", COLLINEAR), obj(3, "Dent", SQUARE, [hole])]})
    put(base / "File1/ann/Car damages 2.jpg.json", {"size": {"width": 60, "height": 40}, "objects": [obj(4, "Paint chip", SQUARE)]})
    put(base / "File1/img/Car damages 1.png", png(100, 80))
    put(base / "File1/img/Car damages 2.jpg", jpeg(60, 40))


def test_supervisely_records(spark, tmp_path):
    make_supervisely(tmp_path)
    got = by_id(supervisely.supervisely_records(spark, str(tmp_path)))
    one, two = got["Car damages 1"], got["Car damages 2"]
    assert (len(one["instances"]), one["n_degenerate"], one["n_holes"]) == (2, 1, 1)
    assert two["instances"][0]["area"] == 400.0 and two["split_hint"] is None
    assert (one["width"], one["height"]) == (100, 80)


@pytest.mark.parametrize("change", [{"classes": ["Hood"]}, {"title": "Hood"}, {"geometry": "bitmap"}])
def test_supervisely_refuses(spark, tmp_path, change):
    make_supervisely(tmp_path, **change)
    with pytest.raises(CorpusError):
        supervisely.supervisely_records(spark, str(tmp_path))


def test_whole_build(spark, tmp_path):
    data = tmp_path / "data"
    make_via(data / "vehide")
    make_coco(data / "cardd")
    make_supervisely(data / "humans-in-the-loop")
    put(data / "cardd/train/000002.jpg", jpeg(60, 60, cut=True))
    out = str(tmp_path / "out")
    report = corpus_plan.build_corpus(spark, str(data), out)
    written = spark.read.parquet(f"{out}/stats")
    assert written.groupBy("source").count().count() == 3 and written.count() == 10
    images, annotations, categories = coco_source.read_triple(spark, f"{out}/cardd")
    assert images.count() == 4 and {r["split"] for r in images.collect()} == {"train", "val", "test"}
    assert [r["name"] for r in categories.orderBy("id").collect()] == ["glass_shatter", "scratch", "tire_flat"]
    counts = coco_source.class_counts(annotations, categories, images).collect()
    assert {r["class"]: r["n"] for r in counts} == {"glass_shatter": 1, "scratch": 1, "tire_flat": 1}
    assert "| cardd |" in report and "Leak-free splits" in report


# -- taxonomy ------------------------------------------------------------------------


def test_taxonomy(spark):
    canonical, mappings = taxonomy.damage_taxonomy(spark)
    taxonomy.require_valid_taxonomy(canonical, mappings)
    assert (canonical.count(), mappings.count()) == (13, 21)
    alone = taxonomy.shared_classes(mappings).filter("n_sources < 2").collect()
    assert [r["canonical"] for r in alone] == ["tire_flat"]
    seen = spark.createDataFrame([("hitl", "Dent"), ("hitl", "Hood")], "source string, source_class string")
    with pytest.raises(UnknownClassError, match="Hood"):
        taxonomy.harmonise(seen, mappings)
    with pytest.raises(UnknownSourceError):
        taxonomy.harmonise(seen.withColumn("source", F.lit("nobody")), mappings)
    good = taxonomy.harmonise(seen.limit(1), mappings)
    coarse = taxonomy.with_coarse_class(good, canonical).first()
    assert (coarse["canonical"], coarse["size"], coarse["class_index"]) == ("dent", "fine", 2)
    with pytest.raises(TaxonomyConfigError):
        taxonomy.with_coarse_class(good, canonical.withColumn("size", F.lit(None).cast("string")))
    mapped = taxonomy.map_with(seen, lambda c: "dent" if c == "Dent" else None).collect()
    assert [r["canonical"] for r in mapped] == ["dent"]


@pytest.mark.parametrize(
    "row, rule",
    [
        (("s", "a", "dent", "merge", "n"), "decision"),
        (("s", "a", "nothing", "map", "n"), "canonical is unknown"),
        (("s", "a", "dent", "map", " "), "note"),
        (("s", "a", "dent", "exclude", "n"), "excluded"),
        (("s", "a", None, "map", "n"), "canonical is missing"),
    ],
)
def test_bad_mappings(spark, row, rule):
    canonical, _ = taxonomy.damage_taxonomy(spark)
    with pytest.raises(TaxonomyConfigError, match=rule):
        taxonomy.require_valid_taxonomy(canonical, spark.createDataFrame([row], schemas.CLASS_MAPPINGS))


@pytest.mark.parametrize(
    "row, rule",
    [(("Bad Name", "d", "g", "fine"), "snake_case"), (("ok", "", "g", None), "empty"), (("ok", "d", "g", "huge"), "size")],
)
def test_bad_classes(spark, row, rule):
    _, mappings = taxonomy.damage_taxonomy(spark)
    bad = spark.createDataFrame([row], schemas.CANONICAL_CLASSES)
    with pytest.raises(TaxonomyConfigError, match=rule):
        taxonomy.require_valid_taxonomy(bad, mappings)


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text(
        "canonical_classes:\n  dent: {description: d, group: g, size: fine}\n"
        "sources:\n  s:\n    Beule: {canonical: ' dent ', decision: map, note: n}\n"
        "    Rest: {canonical: null, decision: exclude, note: n}\n"
    )
    canonical, mappings = taxonomy_file.load_taxonomy(spark, str(path))
    assert canonical.count() == 1
    assert {r["source_class"]: r["canonical"] for r in mappings.collect()} == {"Beule": "dent", "Rest": None}
    path.write_text("canonical_classes: {}\nsources: {}\n")
    with pytest.raises(TaxonomyConfigError):
        taxonomy_file.load_taxonomy(spark, str(path))


# -- statistics and export -----------------------------------------------------------

RING = [10.0, 10.0, 60.0, 10.0, 60.0, 60.0, 10.0, 60.0]


def record(image, classes, source="s", size=(2000, 1500)):
    inst = [(c, [RING], [10.0, 10.0, 50.0, 50.0], 2500.0) for c in classes]
    return (image, f"/x/{image}.jpg", *size, source, None, f"g-{image}", inst)


def test_stats_nested_and_flat_agree(spark):
    rows = [record("a", ["scratch", "dent", "scratch"]), record("b", []), record("c", ["dent"], "t", (0, 0))]
    nested = spark.createDataFrame(rows, schemas.RECORDS)
    per_image = {r["image_id"]: r for r in stats.image_stats(nested).collect()}
    assert (per_image["a"]["megapixels"], per_image["a"]["instances_per_megapixel"]) == (3.0, 1.0)
    assert per_image["a"]["classes"] == "dent|scratch" and per_image["b"]["classes"] == ""
    assert per_image["c"]["instances_per_megapixel"] == 0.0
    flat = stats.image_stats_flat(*records.flatten_records(nested))
    key = lambda r: r["image_id"]
    assert sorted(flat.collect(), key=key) == sorted(stats.image_stats(nested).collect(), key=key)
    again = records.nest_records(*[f.drop("n_instances") for f in records.flatten_records(nested)])
    assert {r["image_id"]: len(r["instances"]) for r in again.collect()} == {"a": 3, "b": 0, "c": 1}
    by_source = {r["source"]: r for r in stats.source_stats(stats.image_stats(nested)).collect()}
    assert (by_source["s"]["density"], by_source["s"]["n_classes"]) == (1.5, 2)


def test_export(spark):
    rows = [record("b", ["scratch", "rust"]), record("a", ["dent"]), record("c", [])]
    triples = []
    for order in (rows, rows[::-1]):
        images, inst = records.flatten_records(spark.createDataFrame(order, schemas.RECORDS))
        mapped = taxonomy.map_with(inst, lambda c: None if c == "rust" else c)
        triples.append([sorted(map(str, t.collect())) for t in coco.coco_triple(images, mapped)])
    assert triples[0] == triples[1]
    images, annotations, categories = coco.coco_triple(images, mapped)
    assert [r["origin_image_id"] for r in images.orderBy("id").collect()] == ["a", "b", "c"]
    assert [(r["id"], r["image_id"], r["category_id"]) for r in annotations.orderBy("id").collect()] == [(1, 1, 1), (2, 2, 2)]
    lines = sinks.coco_document_lines(images, annotations, categories).orderBy("section", "id").collect()
    doc = json.loads("".join(r["value"] for r in lines))
    assert [len(doc[k]) for k in ("images", "annotations", "categories")] == [3, 2, 2]
    twice = spark.createDataFrame([record("a", []), record("a", [])], schemas.RECORDS)
    with pytest.raises(CorpusError, match="duplicate"):
        coco.coco_triple(*records.flatten_records(twice))


def test_select_split_and_paths(spark):
    df = spark.createDataFrame([("a", "train", None), ("b", "val", "/p/b.jpg")], "file_name string, split string, source_file_path string")
    assert records.select_split(df, "val").count() == 1
    with pytest.raises(ValueError, match="train"):
        records.select_split(df, "test")
    got = {r["file_name"]: r["resolved_path"] for r in records.resolve_paths(df, "/root").collect()}
    assert got == {"a": "/root/a", "b": "/p/b.jpg"}
    with pytest.raises(Exception, match="no images root"):
        records.resolve_paths(df).collect()


def test_reconcile(spark):
    actual = spark.createDataFrame([("vehide", 13929, 36047), ("cardd", 4000, 8740), ("hitl", 814, 9079)], "source string, n_images long, n_instances long")
    drops = spark.createDataFrame([("vehide", 2, 16, 32), ("cardd", 0, 0, 0), ("hitl", 4, 0, 0)], "source string, dropped_instances long, corrupted_images long, corrupted_instances long")
    got = {r["source"]: r for r in stats.reconcile(actual, drops, stats.control_totals(spark)).collect()}
    assert (got["vehide"]["image_status"], got["vehide"]["instance_status"]) == ("explained", "explained")
    assert (got["cardd"]["image_status"], got["cardd"]["instance_status"]) == ("exact", "exact")
    assert (got["hitl"]["instance_status"], got["hitl"]["instance_unexplained"]) == ("unexplained", 1)


# -- runs ----------------------------------------------------------------------------


def make_run(root, campaign, name, iou=None, n=100, seed=42, **config):
    base = {"seed": seed, "model": "unet", "copy_paste": False, "density_bucket": None, "corpus": ["a"], "iterations": 1000}
    put(root / campaign / name / "config.json", {**base, **config})
    if iou is not None:
        put(root / campaign / name / "summary.json", {
            "iterations": 1000, "seed": seed, "num_train_images": n, "best_val_iou": iou,
            "best_iteration": 500, "final_train_loss": 0.1, "elapsed_seconds": 3600.0})


def test_run_tables(spark, tmp_path):
    for seed, iou in ((42, 0.30), (43, 0.34), (44, 0.32)):
        make_run(tmp_path, "volume", f"n100_seed{seed}", iou, seed=seed)
    make_run(tmp_path, "volume", "n200_seed42", 0.41, n=200)
    make_run(tmp_path, "density", "d1", 0.2, density_bucket=[4, None])
    make_run(tmp_path, "density", "d0", 0.2, density_bucket=[1, 1])
    make_run(tmp_path, "ablation", "cp", 0.5, n=200, copy_paste=True)
    make_run(tmp_path, "volume", "unfinished")
    history = tmp_path / "volume/unfinished/history.jsonl"
    history.write_text('{"type": "train", "iteration": 200, "loss": 1.0}\n{"type": "train", "iteration": 250, "loss": 0.5}\n{"type": "val", "iterat')
    tables = results.result_tables(spark, str(tmp_path), str(tmp_path / "out"))
    assert tables["runs"].count() == 7
    volume = tables["volume"].collect()
    assert [r["num_train_images"] for r in volume] == [100, 200]
    assert (volume[0]["n_seeds"], volume[0]["iou_min"], volume[0]["iou_max"]) == (3, 0.30, 0.34)
    assert volume[0]["iou_mean"] == pytest.approx(0.32) and volume[1]["iou_std"] is None
    assert [r["density_bucket"] for r in tables["density"].collect()] == ["1", "4+"]
    ablation = {r["condition"]: r["iou_mean"] for r in tables["ablations"].collect()}
    assert ablation == {"Référence (U-Net)": 0.41, "Copy-Paste": 0.5}
    assert run_files.run_events(spark, str(history)).count() == 2
    elapsed = spark.createDataFrame([("volume", "unfinished", 500.0)], "campaign string, run string, elapsed_seconds double")
    outlook = results.campaign_status(spark, str(tmp_path), elapsed, expected=10).first()
    assert (outlook["n_done"], outlook["n_running"], outlook["n_queued"]) == (7, 1, 2)
    assert outlook["seconds_left"] == pytest.approx(750 * 2.0 + 2 * 3600)


def test_grid(spark):
    from annotary.operators import runs as r

    spec = spark.createDataFrame([("50, ,100,full", "42,43", "1,4+")], "points string, seeds string, buckets string")
    grid = r.run_grid(spec)
    assert [x["run"] for x in grid.orderBy("point_place", "seed_place").collect()][-1] == "nfull_seed43"
    assert grid.count() == 6 and r.run_grid(spec, density=True).count() == 12
    done = spark.createDataFrame([("n50_seed42",)], "run string")
    assert r.pending_runs(grid, done).count() == 5 and r.pending_runs(grid, done, force=True).count() == 6


def test_document_parts_concatenate(spark, tmp_path):
    rows = [record(f"i{k:02d}", ["dent"] * (k % 3)) for k in range(20)]
    images, inst = records.flatten_records(spark.createDataFrame(rows, schemas.RECORDS))
    triple = coco.coco_triple(images, inst.withColumn("canonical", F.col("source_class")))
    sinks.write_coco_document(*triple, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert [im["id"] for im in doc["images"]] == list(range(1, 21))
    assert len(doc["annotations"]) == sum(k % 3 for k in range(20)) and doc["annotations"][0]["iscrowd"] == 0
    assert sinks.markdown_table(triple[2]).splitlines()[0] == "| id | name | supercategory |"


# -- one document, many tasks ------------------------------------------------------------

TRICKY = {
    "info": {"a": {"deep": "} \" ] {"}, "b": [1, {"c": 2}]},
    "version": 1.5,
    "empty": [],
    "images": [{"id": 1, "file_name": "a}b{\".jpg", "o": {"x": [1, [2]]}}, {"id": 2, "file_name": "\\"}, {"id": 3, "file_name": "é},{"}],
    "licenses": ["none", "{"],
    "annotations": [{"id": k, "text": '", "images": [{' * (k % 3), "segmentation": [[k, 1.5]]} for k in range(40)],
}


@pytest.mark.parametrize("indent, block", [(None, 1 << 20), (None, 37), (2, 64), (2, 1 << 20)])
def test_document_in_blocks(spark, tmp_path, indent, block):
    text = json.dumps(TRICKY, indent=indent, ensure_ascii=False)
    (tmp_path / "doc.json").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = document.document_sections(spark, str(tmp_path / "doc.json")).orderBy("place").collect()
        (tmp_path / "map.json").write_text(json.dumps(dict(enumerate(TRICKY["annotations"])), indent=indent) + "\n")
        entries = document.document_entries(spark, str(tmp_path / "map.json")).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r["section"], []).append(json.loads(r["element"]))
    assert got == {k: TRICKY[k] for k in ("images", "annotations")}
    assert [json.loads(r["entry"]) for r in entries] == [{str(k): v} for k, v in enumerate(TRICKY["annotations"])]


def test_document_in_parts(spark, tmp_path):
    text = json.dumps(TRICKY, ensure_ascii=False)
    cuts = [0, 5, 60, 61, 200, 201, 333, len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"part-{k:03d}.json").write_text(text[a:b], encoding="utf-8")
    rows = document.document_sections(spark, str(tmp_path)).orderBy("place").collect()
    assert [json.loads(r["element"]) for r in rows if r["section"] == "annotations"] == TRICKY["annotations"]
    assert [json.loads(r["element"]) for r in rows if r["section"] == "images"] == TRICKY["images"]


def test_watch_counts_in_the_job_itself(spark):
    _, mappings = taxonomy.damage_taxonomy(spark)
    seen = spark.createDataFrame(
        [("hitl", "Dent"), ("hitl", "Hood"), ("hitl", None), ("nobody", "Dent")], "source string, source_class string"
    )
    good, watch = taxonomy.harmonise_watched(seen, mappings)
    assert [r["canonical"] for r in good.collect()] == ["dent"]
    assert list(watch.counts().values()) == [1, 3]
    with pytest.raises(UnknownSourceError, match="nobody/Dent"):
        watch.require()
    good, watch = taxonomy.harmonise_watched(seen.filter("source = 'hitl'"), mappings)
    good.collect()
    with pytest.raises(UnknownClassError, match="2 rows"):
        watch.require()
    with pytest.raises(Exception, match="taxonomy coverage: unknown class hitl/Hood"):
        taxonomy.harmonise(seen.filter("source_class = 'Hood'"), mappings, within=True).collect()
    assert taxonomy.harmonise(seen.limit(1), mappings, within=True).count() == 1
    nulls = taxonomy.map_with(seen, lambda c: "none" if c is None else "some").groupBy("canonical").count().collect()
    assert {r["canonical"]: r["count"] for r in nulls} == {"none": 1, "some": 3}


# -- listing in tasks ---------------------------------------------------------------------


def test_list_tree(spark, tmp_path):
    files = {
        "top.png": png(7, 5),
        "a/one.jpg": jpeg(640, 480),
        "a/b/two.jpg": b"\xff\xd8\xff\xe1" + struct.pack(">H", 60_002) + b"\0" * 60_000 + jpeg(30, 20)[2:],
        "a/b/c/note.txt": b"not an image",
        "d/empty.jpg": b"",
        "d/cut.png": png(9, 9)[:20],
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = listing.list_tree(spark, [str(tmp_path)], sizes=True).collect()
    got = {r["path"].removeprefix(f"{tmp_path}/"): (r["length"], r["width"], r["height"]) for r in rows}
    sizes = {"top.png": (7, 5), "a/one.jpg": (640, 480), "a/b/two.jpg": (30, 20)}
    assert len(rows) == len(files) and got == {n: (len(d), *sizes.get(n, (None, None))) for n, d in files.items()}
    plain = listing.list_tree(spark, [f"{tmp_path}/a", f"{tmp_path}/d"])
    assert plain.columns == ["path", "length"]
    (tmp_path / "a" / "_hidden").mkdir()
    (tmp_path / "a" / "_hidden" / "x.jpg").write_bytes(b"x")
    assert {r["path"] for r in plain.filter("length > 0").collect()} == {
        r["path"] for r in image_source.list_files(spark, [f"{tmp_path}/a", f"{tmp_path}/d"]).collect()
    }


def test_document_with_long_members_before_its_sections(spark, tmp_path):
    """A head of many numbers and escaped strings is matched without recursion."""
    head = {"info": {"note": 'a "quoted" } brace \\'}, "numbers": list(range(60_000)), "words": ["\\\"{[" * 3] * 5_000}
    images = [{"id": k, "file_name": f"{k}]}}.jpg", "width": 4, "height": 3} for k in range(50)]
    path = tmp_path / "long.json"
    path.write_text(json.dumps({**head, "images": images, "annotations": []}))
    found = document.document_sections(spark, str(path)).filter("section = 'images'").orderBy("place").collect()
    assert [json.loads(r["element"]) for r in found] == images


def test_compressed_document_in_parts(spark, tmp_path):
    """Part files of any cut are read compressed as well, also if one ends in a brace; each becomes one block."""
    text = json.dumps(TRICKY, ensure_ascii=False)
    brace = text.index('}, {"id": 7,') + 1
    cuts = [0, 5, 60, 201, brace, len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"part-{k:03d}.json.gz").write_bytes(gzip.compress(text[a:b].encode()))
    rows = document.document_sections(spark, str(tmp_path)).orderBy("place").collect()
    for name in ("images", "annotations"):
        assert [json.loads(r["element"]) for r in rows if r["section"] == name] == TRICKY[name]


def test_sized_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in b}
    before = shuffled()
    table = sized(spark.range(1000).repartition(7, "id").groupBy("id").count())
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:  # files are deleted in the background
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 1000
