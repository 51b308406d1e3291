from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.functions import guid
from girder.operators import edges, ingest
from girder.queries import model_records
from girder.scratch import Scratch
from girder.sources import step
from girder.sources.ifc_schema import from_express, table_of

SF = "/root/testdata/sf0.001"
DEMO = """ISO-10303-21;
HEADER;
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
#1= IFCPROJECT('0YvctVUKr0kugbFTf53O9L',$,'Demo; Project',$,$,$,$,(#90),$);
#2=IFCSITE('1YvctVUKr0kugbFTf53O9L',$,'Site',
   $,$,$,$,$,.ELEMENT.,$,$,$,$,$);
#3=IFCRELAGGREGATES('2YvctVUKr0kugbFTf53O9L',$,$,$,#1,(#2));
#4=IFCWALL('3YvctVUKr0kugbFTf53O9L',$,'Wall ''A''',$,$,#80,$,'T1',.SOLIDWALL.);
#5=IFCRELCONTAINEDINSPATIALSTRUCTURE('2YvctVUKr0kugbFTf53O9M',$,$,$,(#4,#99),#2);
#6=IFCCOMPLEXTHING(#4,#2,(#4),'#1');
#80=IFCLOCALPLACEMENT($,#81);
#81=IFCAXIS2PLACEMENT3D(#82,$,$);
#82=IFCCARTESIANPOINT((1.,2.5,-3.));
broken line
ENDSEC;
"""


def records(spark, text=DEMO):
    return step.records(spark.createDataFrame([("m", text)], "model_id string, text string"))


def test_records(spark):
    rows = {r.entity_id: r for r in records(spark).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 80, 81, 82]
    assert rows[1].arg_list[2] == "'Demo; Project'"
    assert len(rows[2].arg_list) == 14 and "\n" not in rows[2].args
    assert rows[4].arg_list[2] == "'Wall ''A'''"
    assert records(spark, "").count() == 0 and records(spark, None).count() == 0


@given(st.lists(st.text(alphabet="ab,()';# \n", max_size=8), min_size=1, max_size=6))
def test_encoded_texts_come_back(values):
    args = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    assert step.split_arguments(args) == ["'" + v.replace("'", "''") + "'" for v in values]
    found = list(step.parse_step(f"DATA;\n#7=IFCX({args});"))
    assert [n for n, _, _ in found] == [7]


def test_edges_and_placements(spark):
    rec = records(spark)
    made = {tuple(r) for r in edges.extract_edges(rec).select("subject", "predicate", "object").collect()}
    assert made == {(1, "IfcRelAggregates", 2), (2, "IfcRelContainedInSpatialStructure", 4), (6, "references", 4), (6, "references", 2)}
    assert edges.filter_profile(edges.extract_edges(rec), "qto").count() == 2
    assert [tuple(r) for r in edges.placement_points(rec).collect()] == [("m", 80, 1.0, 2.5, -3.0)]


def test_ingest(spark):
    tables = ingest.ingest(records(spark))
    wall = tables.entities.where("entity_id = 4").first()
    assert (wall.name, wall.tag, wall.predefined_type, wall.description) == ("Wall 'A'", "T1", "SOLIDWALL", None)
    assert wall.global_id_canonical == guid_of(spark, "3YvctVUKr0kugbFTf53O9L")
    assert tables.attributes.where("entity_id = 4 AND attr_name = 'Tag'").first().value == "T1"


def guid_of(spark, text):
    return spark.range(1).select(guid.canonical(F.lit(text))).first()[0]


def test_global_ids(spark):
    pairs = [("2vfBj$L2v0kQR$Wm$wRYol", "b9a4bb7f-542e-40b9-a6ff-830ffa6e2caf")]
    for short, long in pairs:
        row = spark.range(1).select(guid.decode(F.lit(short)), guid.encode(F.lit("{" + long.upper() + "}")), guid.to_compressed(F.lit(short))).first()
        assert tuple(row) == (long, short, short)
    assert guid_of(spark, "nothing") is None and guid_of(spark, "2vfBj$L2v0kQR$Wm$wRY!l") is None


def test_express():
    text = """ENTITY IfcRoot ABSTRACT SUPERTYPE OF (ONEOF(IfcWall));
      GlobalId : IfcId;
      Name : OPTIONAL IfcLabel;
    END_ENTITY;
    ENTITY IfcWall SUBTYPE OF (IfcRoot);
      Tag : OPTIONAL IfcLabel;
     WHERE
      Right : TRUE;
    END_ENTITY;"""
    assert from_express(text)["IFCWALL"] == ("GlobalId", "Name", "Tag")
    assert table_of("IFC4")["IFCSIUNIT"] == ("Dimensions", "UnitType", "Prefix", "Name")
    assert table_of(None)["IFCPUMPTYPE"][4:6] == ("ApplicableOccurrence", "HasPropertySets")


def test_schema_tables():
    latest, older = table_of("IFC4X3"), table_of("ifc2x3")
    assert len(latest) > 500 and "IFCNOSUCHCLASS" not in latest
    assert latest["IFCSTAIRFLIGHT"][8:] == ("NumberOfRisers", "NumberOfTreads", "RiserHeight", "TreadLength", "PredefinedType")
    assert latest["IFCDOORPANELPROPERTIES"][4:] == ("PanelDepth", "PanelOperation", "PanelWidth", "PanelPosition", "ShapeAspectStyle")
    assert older["IFCSTAIR"][-1] == "ShapeType" and latest["IFCSTAIR"][-1] == "PredefinedType"
    assert table_of("IFC9", {"IFC9": {"IFCX": ("A",)}}) == {"IFCX": ("A",)}
    assert all(len(set(names)) == len(names) for names in (*latest.values(), *older.values()))


def test_comments_and_members(spark):
    text = "DATA;\n/* #1=IFCWALL('no'); */ #2=IFCX('a /* b */ c',/* d */ ('x','y, z'),(#1,(#2)),$);"
    row = records(spark, text).first()
    assert (row.entity_id, row.arg_list[0], row.schema) == (2, "'a /* b */ c'", "UNKNOWN")
    assert row.members == [None, ["'x'", "'y, z'"], ["#1", "(#2)"], None]


def test_given_schema_goes_first(spark):
    rows = ingest.named_arguments(records(spark), {"IFC4": {"IFCWALL": ("A", "B")}, "IFC4X3": {}}).where("entity_id = 4").orderBy("pos").collect()
    assert [r.attr_name for r in rows[:3]] == ["A", "B", "[2]"]


def broadcasts(df):
    """The joins that send a side through the driver, as Spark plans them from its guess of sizes."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_kept_records_are_never_broadcast(spark):
    found = broadcasts(edges.named_edges(model_records(spark, SF)))
    assert found
    assert all("[rule_type" in line for line in found)  # the table of rules


def test_linked_pairs_are_never_broadcast(spark, tmp_path):
    edges.named_edges(model_records(spark, SF)).write.parquet(f"{tmp_path}/named")
    found = broadcasts(edges.generic_edges(model_records(spark, SF), spark.read.parquet(f"{tmp_path}/named")))
    assert found == []


def test_all_edges_are_never_broadcast(spark):
    assert broadcasts(edges.extract_edges(model_records(spark, SF))) == []


def test_all_steps_of_all_edges_run_without_broadcasts_of_records(spark, monkeypatch):
    """The plans as they ran, those of the written steps included."""
    ran, save = [], Scratch.save

    def run(df):
        df.collect()
        assert "isFinalPlan=true" in df._jdf.queryExecution().executedPlan().toString()
        ran.append(broadcasts(df))

    def watched(self, df, name):
        if name != "records":  # a plan without joins
            run(df)
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", watched)
    run(edges.extract_edges(model_records(spark, SF)))
    named, last = ran
    assert named
    assert all("[rule_type" in line for line in named)  # the table of rules
    assert last == []


def test_entities_are_never_broadcast(spark):
    assert broadcasts(ingest.ingest(model_records(spark, SF)).entities) == []


def test_properties_are_never_broadcast(spark):
    assert broadcasts(ingest.ingest(model_records(spark, SF)).properties) == []
