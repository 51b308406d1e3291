from __future__ import annotations

from dataclasses import replace

import pytest

from girder.functions.errors import SpecEvaluationError, StaleSnapshotError
from girder.mapping import star_model
from girder.operators import lookup, report
from girder.plans.evaluate import check_ids, evaluate_document, evaluate_spec, spec_frame
from girder.plans.rules import Attribute, Document, Entity, PartOf, Pattern, Property, Requirement, Simple, Specification
from girder.schema import ATTRIBUTES, ENTITIES, PROPERTIES, TRIPLES, ModelTables
from girder.sources.store import ModelCache, ModelStore, export_snapshot, import_snapshot, load_models

SF = "/root/testdata/sf0.001"
IDS = """<ids><info><title>T &amp; U</title></info><specifications><specification name="Doors, all">
<applicability><entity><name><simpleValue>IFCDOOR</simpleValue></name></entity></applicability><requirements>
<attribute><name><simpleValue>Name</simpleValue></name></attribute>
<attribute><name><simpleValue>Tag</simpleValue></name></attribute></requirements></specification>
<specification name="None"><applicability minOccurs="0"><entity><name><simpleValue>IFCPUMP</simpleValue></name></entity></applicability></specification>
<specification name="Gone"><applicability><entity><name><simpleValue>IFCPUMP</simpleValue></name></entity></applicability></specification>
</specifications></ids>"""


def tiny(spark):
    entity = lambda i, kind, **more: tuple(("m", i, kind)[k] if k < 3 else more.get(f.name) for k, f in enumerate(ENTITIES.fields))
    return ModelTables(
        spark.createDataFrame([entity(1, "IFCDOOR", name='a,"b"'), entity(2, "IFCDOOR", name="c", tag="t"), entity(3, "IFCDOORTYPE", predefined_type="GATE"), entity(4, "IFCSITE", name="s")], ENTITIES),
        spark.createDataFrame([("m", 3, "IfcRelDefinesByType", 1), ("m", 4, "IfcRelAggregates", 1), ("m", 1, "IfcRelAggregates", 2)], TRIPLES),
        spark.createDataFrame([("m", 1, "P", "x", "1", 1.0, 1.0, None, "IFCREAL"), ("m", 1, "P", "x", "2", 2.0, 2.0, None, "IFCREAL"), ("m", 1, "Q", "y", "1", 1.0, 1.0, None, None), ("m", 3, "P", "z", "9", 9.0, 9.0, None, None), ("m", 3, "T", "z", "9", 9.0, 9.0, None, None)], PROPERTIES),
        spark.createDataFrame([("m", 1, "Roles", "r1"), ("m", 1, "Roles", "r2"), ("m", 1, "Empty", "")], ATTRIBUTES),
    )


def flags(spark, facet, cardinality="required"):
    spec = Specification("s", "S", (Entity(Simple("IFCDOOR")),), (Requirement(facet, cardinality),))
    return {r.entity_id: r.req0 for r in spec_frame(tiny(spark), spec).collect()}


@pytest.mark.parametrize(
    ("facet", "wanted"),
    [
        (Property(Simple("P"), Simple("x"), Simple("2")), {1: True, 2: False}),
        (Property(Pattern("P|Q"), Simple("x")), {1: False, 2: False}),  # Q lacks x
        (Property(Simple("P"), Simple("z")), {1: False, 2: False}),  # the occurrence's set hides the type's
        (Property(Simple("T"), Simple("z")), {1: True, 2: False}),
        (Property(Simple("Q"), Simple("y"), Simple("1"), "IFCLABEL"), {1: True, 2: False}),  # no type: not refused
        (Attribute(Simple("roles"), Simple("r2")), {1: True, 2: False}),
        (Attribute(Simple("Empty")), {1: False, 2: False}),
        (Entity(Simple("IFCDOOR"), Simple("GATE")), {1: True, 2: False}),
        (PartOf("", Entity(Simple("IFCSITE"))), {1: True, 2: True}),
        (PartOf("IFCRELNESTS"), {1: False, 2: False}),
    ],
)
def test_facets(spark, facet, wanted):
    assert flags(spark, facet) == wanted


def test_predefined_types_of_rows_that_share_an_id(spark):
    tables = tiny(spark)
    twin = spark.createDataFrame([("m", 3, "IFCMATERIAL", *[None] * (len(ENTITIES.fields) - 3))], ENTITIES)
    tables = replace(tables, entities=tables.entities.unionByName(twin))
    spec = Specification("s", "S", (Entity(Simple("IFCDOOR")),), (Requirement(Entity(Simple("IFCDOOR"), Simple("GATE"))),))
    assert sorted((r.entity_id, r.req0) for r in spec_frame(tables, spec).collect()) == [(1, True), (2, False)]


def test_values_and_reports(spark):
    doc, results = check_ids(tiny(spark), IDS)
    rows = report.document_report(doc, results, {"m": "Model"})
    text = report.report_to_csv(rows)
    assert text.split("\r\n") == [
        report.CSV_HEADER,
        '"Doors, all",Model,1,IFCDOOR,"a,""b""",Attribute Tag,required,(missing)',
        "Gone,,,,,Specification cardinality,required,\"Required, but no applicable entity found in the model.\"",
    ]
    page = report.report_to_html(doc, results)
    assert "T &amp; U" in page and "3/4 (75%)" in page and "a,&quot;b&quot;" in page and "Specification cardinality not satisfied" in page
    hidden = report.report_to_html(doc, results, hide_not_applicable=True)
    assert "1 not-applicable specification hidden" in hidden
    progress = report.spec_progress(results["spec-0"]).first()
    assert (progress.n_pass, progress.n_partial, progress.n_fail, progress.percent) == (1, 1, 0, 75)


def test_bad_pattern_is_an_error(spark):
    spec = Specification("s", "S", (), (Requirement(Attribute(Simple("Name"), Pattern("(")),),))
    with pytest.raises(SpecEvaluationError):
        evaluate_spec(tiny(spark), spec)


def test_lookup(spark):
    rows = lookup.element_info(tiny(spark), ["m:1", "m:1", "m:99", "x", "m:1a"]).collect()
    assert [(r.uid, r.name, r.bbox) for r in rows] == [("m:1", 'a,"b"', None)]


def test_store_and_snapshots(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}/store")
    tables = tiny(spark)
    store.save(tables)
    store.save(tables)
    assert store.models() == ["m"] and store.load().entities.count() == 4
    store.drop("m")
    assert store.models() == [] and store.load(["m"]).properties.count() == 0
    export_snapshot(tables, f"file://{tmp_path}/snap")
    assert import_snapshot(spark, f"file://{tmp_path}/snap").triples.count() == 3
    (tmp_path / "snap" / "_manifest.json").write_text('{"format": "old"}')
    (tmp_path / "snap" / "._manifest.json.crc").unlink()
    with pytest.raises(StaleSnapshotError):
        import_snapshot(spark, f"file://{tmp_path}/snap")
    cache = ModelCache(spark, f"file://{tmp_path}/cache")
    cache.write("m", tables)
    assert [m for m, _ in cache.list()] == ["m"] and cache.restore("m").entities.count() == 4 and cache.restore("n") is None
    cache.clear()
    assert cache.list() == []


def test_saving_again_leaves_no_stale_rows(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}/store")
    tables = tiny(spark)
    store.save(tables)
    store.save(replace(tables, properties=tables.properties.limit(0)))
    assert store.load().properties.count() == 0 and store.load().attributes.count() == 3
    store.save(replace(tables, **{n: getattr(tables, n).limit(0) for n in ("entities", "triples", "properties", "attributes")}), ["m"])
    assert store.models() == [] and store.load().triples.count() == 0


MODEL = "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCWALL('0YvctVUKr0kugbFTf53O9L',$,'{name}',$,$,$,$,$,$);\nENDSEC;\n"


def test_load_models(spark, tmp_path):
    files = tmp_path / "models"
    files.mkdir()

    def put(name, raw):
        (files / name).write_bytes(raw)

    def load(cache):
        ids, tables = load_models(spark, f"file://{files}/*.ifc", cache)
        return ids, sorted(r.name for r in tables.entities.collect())

    put("a.ifc", MODEL.format(name="A").encode())
    put("b.ifc", MODEL.format(name="Gru\xdf").encode("latin-1"))
    put("copy.ifc", MODEL.format(name="A").encode())
    cache = ModelCache(spark, f"file://{tmp_path}/cache")
    ids, names = load(cache)
    assert len(ids) == 2 and names == ["A", "Gru\xdf"] and {m for m, _ in cache.list()} == set(ids)
    put("empty.ifc", b"")  # Spark's readers skip files of no bytes: no model
    put("nothing.ifc", b"ISO-10303-21;\nDATA;\nENDSEC;\n")
    put("broken.ifc", MODEL.format(name="C").encode()[:-30] + b"\xff\xfe\x00")
    mixed, names = load(cache)  # cached, new, empty and cut-off files at once
    assert len(mixed) == 4 and set(ids) < set(mixed) and names == ["A", "Gru\xdf"]
    assert load(cache)[1] == load(None)[1] == names  # all cached; none
    cache.delete(ids[0])
    assert {m for m, _ in cache.list()} == set(mixed) - {ids[0]} and cache.restore(ids[0]) is None
    assert load(cache) == (mixed, names) and cache.restore(ids[0]).entities.count() == 1


def test_load_survives_a_cache_that_cannot_be_written(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ifc").write_text(MODEL.format(name="A"))
    cache = ModelCache(spark, f"file://{tmp_path}/cache")

    def full(*_):
        raise OSError("no space")

    monkeypatch.setattr(cache.store, "save", full)
    with pytest.warns(UserWarning, match="no space"):
        ids, tables = load_models(spark, f"file://{tmp_path}/a.ifc", cache)
    assert tables.entities.first().name == "A" and cache.list() == []


def test_cache_of_another_format_is_purged(spark, tmp_path, monkeypatch):
    from girder.sources import store

    cache = ModelCache(spark, f"file://{tmp_path}/cache")
    cache.write("m", tiny(spark))
    monkeypatch.setattr(store, "FORMAT", "girder-0")
    assert cache.restore("m") is None and cache.list() == []
    assert cache.store.models() == []


def test_lenient_evaluation(spark):
    good = Specification("s", "S", (Entity(Simple("IFCDOOR")),), (Requirement(Attribute(Simple("Tag"))),))
    bad = Specification("b", "B", (), (Requirement(Attribute(Simple("Name"), Pattern("(")),),))
    document = Document("d", (bad, good))
    with pytest.raises(SpecEvaluationError):
        evaluate_document(tiny(spark), document)
    with pytest.warns(UserWarning, match="B"):
        results = evaluate_document(tiny(spark), document, lenient=True)
    assert list(results) == ["b", "s"] and results["b"].count() == 0 and results["s"].count() == 2


def test_document_in_one_pass_equals_each_specification(spark):
    facets = [Attribute(Simple("Tag")), Property(Simple("P"), Simple("x")), PartOf("", Entity(Simple("IFCSITE"))), Attribute(Simple("Tag"), Simple("pt_"))]
    specs = [Specification(f"s{k}", f"S{k}", (Entity(Simple("IFCDOOR" if k % 3 else "IFCDOORTYPE")),), (Requirement(facets[k % 4], "optional" if k % 2 else "required"),)) for k in range(20)]
    specs.append(Specification("all", "All", (), (Requirement(Attribute(Simple("Name"))),)))
    results = evaluate_document(tiny(spark), Document("d", tuple(specs)))
    for spec in specs[::4]:
        frame = spec_frame(tiny(spark), spec)
        wanted = sorted((r.entity_id, r.req0 or ("anc0" in r and not r.anc0)) for r in frame.collect())
        assert sorted((r.entity_id, r.checks[0].passed) for r in results[spec.id].collect()) == wanted


def test_large_reports(spark, tmp_path):
    doc, results = check_ids(tiny(spark), IDS)
    rows = report.document_report(doc, results)
    report.write_csv(rows, f"file://{tmp_path}/csv")
    text = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert text.decode() == report.report_to_csv(rows) + "\r\n"
    pages = list(report.html_pages(doc, results, page_size=1))
    assert len(pages) == 2 and sum(p.count("<tr><td rowspan") for p in pages) == 2
    assert "Partial (1)" in pages[0] and "Pass (1)" in pages[1] and all("3/4 (75%)" in p for p in pages)


def test_streaming(spark, tmp_path):
    from girder.streaming.revalidate import revalidate

    root = f"file://{tmp_path}/store"
    ModelStore(spark, root).save(tiny(spark))
    spec = Specification("s", "S", (Entity(Simple("IFCDOOR")),), (Requirement(Attribute(Simple("Tag"))),))
    revalidate(spark, root, Document("d", (spec,)), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == star_model(spark, SF).entities.where("ifc_type = 'IFCDOOR'").count()
