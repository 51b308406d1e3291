from __future__ import annotations

import pytest

from girder.functions.errors import RuleError
from girder.functions.numbers import interval, literal
from girder.functions.xsd_pattern import full_match, has_subtraction, java_pattern
from girder.plans.rules import Attribute, Bounds, Classification, Entity, Length, OneOf, PartOf, Pattern, Property, Requirement, Simple, parse_ids

XML = """<?xml version="1.0"?>
<x:ids xmlns:x="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <x:info><x:title> Rules </x:title><x:author>a@b.c</x:author></x:info>
 <x:specifications>
  <x:specification name="Walls" ifcVersion="IFC2X3  IFC4" description="d">
   <x:applicability minOccurs="0"><x:entity><x:name><x:simpleValue>IFCWALL</x:simpleValue></x:name></x:entity></x:applicability>
   <x:requirements>
    <x:property dataType="IFCLABEL" cardinality="Optional"><x:propertySet><x:simpleValue>Pset</x:simpleValue></x:propertySet>
      <x:baseName><xs:restriction><xs:pattern value="A.*"/><xs:pattern value="B"/></xs:restriction></x:baseName>
      <x:value><xs:restriction base="xs:double"><xs:minInclusive value="1"/><xs:maxExclusive value="2.5"/></xs:restriction></x:value></x:property>
    <x:attribute maxOccurs="0"><x:name>Tag</x:name><x:value><xs:restriction><xs:length value="3"/></xs:restriction></x:value></x:attribute>
    <x:classification><x:system><x:simpleValue> </x:simpleValue></x:system><x:value><xs:restriction><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:restriction></x:value></x:classification>
    <x:partOf relation="IfcRelAggregates"><x:entity><x:name><x:simpleValue>IFCSITE</x:simpleValue></x:name></x:entity></x:partOf>
    <x:unknown/>
   </x:requirements>
  </x:specification>
  <x:specification/>
 </x:specifications>
</x:ids>"""


def test_document_is_read():
    doc = parse_ids(XML)
    assert (doc.title, doc.author, doc.date) == ("Rules", "a@b.c", None)
    walls, bare = doc.specifications
    assert (walls.id, walls.name, walls.ifc_version, walls.cardinality, walls.description) == ("spec-0", "Walls", ("IFC2X3", "IFC4"), "optional", "d")
    assert walls.applicability == (Entity(Simple("IFCWALL")),)
    assert walls.requirements == (
        Requirement(Property(Simple("Pset"), Pattern("(A.*)|(B)"), Bounds(1, 2.5, True, False), "IFCLABEL"), "optional"),
        Requirement(Attribute(Simple("Tag"), Length(3.0)), "prohibited"),
        Requirement(Classification(None, OneOf(("a", "b"))), "required"),
        Requirement(PartOf("IFCRELAGGREGATES", Entity(Simple("IFCSITE"))), "required"),
    )
    assert (bare.name, bare.cardinality, bare.applicability, bare.requirements) == ("Specification 2", "required", (), ())


@pytest.mark.parametrize("xml", ["<a/>", "<ids", ""])
def test_other_documents_are_refused(xml):
    with pytest.raises(RuleError):
        parse_ids(xml)


def test_labels():
    assert Requirement(Property(Simple("P"), Pattern("x")), "prohibited").label() == "No Property P./x/"
    assert Requirement(Attribute(Bounds(1.0, None)), "optional").label() == "Attribute [1..]"
    assert Requirement(PartOf()).label() == "Part of relation"
    assert Requirement(Classification()).label() == "Classification"
    assert Requirement(PartOf(), "prohibited").expectation() == "must NOT be present"
    assert Length(None, 2, 3).label() == "length 2..3"


def test_tolerance_bounds():
    low, high = interval(literal("100000."), True)
    assert low <= 99999.899999 and high >= 100000.100001
    low, high = interval(-0.0000001, True)
    assert low <= 0.0000009000001 <= high and not 0.00000090000011 <= high
    assert literal("1d") is None and literal("nan") is None and literal(" .5 ") == 0.5


def test_class_subtraction():
    assert java_pattern(r"[a-z-[aeiou]]") == r"[[a-z]&&[^[aeiou]]]"
    assert java_pattern(r"\[a-[b]") == r"\[a-[b]"
    assert has_subtraction("[a-[b]]") and not has_subtraction("[a-z]+")
    assert full_match("a|b") == r"(?d)\A(?:a|b)\z"
