"""Requirement documents: syntax tree and XML reader. Rules are small and live on the driver."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

from girder.functions.errors import RuleError


@dataclass(frozen=True)
class Simple:
    value: str

    def label(self) -> str:
        return self.value


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]

    def label(self) -> str:
        return "|".join(self.values)


@dataclass(frozen=True)
class Pattern:
    pattern: str

    def label(self) -> str:
        return f"/{self.pattern}/"


@dataclass(frozen=True)
class Length:
    exact: float | None = None
    least: float | None = None
    most: float | None = None

    def label(self) -> str:
        return f"length {_plain(self.exact)}" if self.exact is not None else f"length {_plain(self.least)}..{_plain(self.most)}"


@dataclass(frozen=True)
class Bounds:
    low: float | None = None
    high: float | None = None
    low_included: bool = False
    high_included: bool = False

    def label(self) -> str:
        return f"[{_plain(self.low)}..{_plain(self.high)}]"


Restriction = Simple | OneOf | Pattern | Length | Bounds


def _plain(value: float | None) -> str:
    """A number as rule authors write it: no trailing ``.0``."""
    if value is None:
        return ""
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(float(value))


@dataclass(frozen=True)
class Entity:
    name: Restriction
    predefined_type: Restriction | None = None

    def label(self) -> str:
        return f"Entity {self.name.label()}"


@dataclass(frozen=True)
class Attribute:
    name: Restriction
    value: Restriction | None = None

    def label(self) -> str:
        return f"Attribute {self.name.label()}"


@dataclass(frozen=True)
class Property:
    property_set: Restriction
    base_name: Restriction
    value: Restriction | None = None
    data_type: str | None = None

    def label(self) -> str:
        return f"Property {self.property_set.label()}.{self.base_name.label()}"


@dataclass(frozen=True)
class Classification:
    system: Restriction | None = None
    value: Restriction | None = None

    def label(self) -> str:
        return f"Classification {self.system.label() if self.system else ''}".strip()


@dataclass(frozen=True)
class Material:
    value: Restriction | None = None

    def label(self) -> str:
        return f"Material {self.value.label() if self.value else ''}".strip()


@dataclass(frozen=True)
class PartOf:
    relation: str = ""
    entity: Entity | None = None

    def label(self) -> str:
        return f"Part of {self.relation or 'relation'}"


Facet = Entity | Attribute | Property | Classification | Material | PartOf
CARDINALITIES = ("required", "optional", "prohibited")


@dataclass(frozen=True)
class Requirement:
    facet: Facet
    cardinality: str = "required"

    def label(self) -> str:
        return ("No " if self.cardinality == "prohibited" else "") + self.facet.label()

    def expectation(self) -> str:
        return "must NOT be present" if self.cardinality == "prohibited" else self.cardinality


@dataclass(frozen=True)
class Specification:
    id: str
    name: str
    applicability: tuple[Facet, ...] = ()
    requirements: tuple[Requirement, ...] = ()
    cardinality: str = "required"
    description: str | None = None
    ifc_version: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Document:
    title: str
    specifications: tuple[Specification, ...] = field(default=())
    description: str | None = None
    author: str | None = None
    date: str | None = None


# Reading XML: elements are found by local name, whatever their namespace and case.


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower() if isinstance(element.tag, str) else ""


def _all(parent: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (c for c in (parent if parent is not None else ()) if _name(c) == name.lower())


def _first(parent: ET.Element | None, name: str) -> ET.Element | None:
    return next(_all(parent, name), None)


def _text(element: ET.Element | None) -> str:
    return "".join(element.itertext()).strip() if element is not None else ""


def _number(element: ET.Element | None) -> float | None:
    """The finite number in the attribute ``value``; an empty one counts as absent."""
    written = (element.get("value") if element is not None else None) or ""
    try:
        value = float(written)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def read_restriction(holder: ET.Element | None) -> Restriction | None:
    """The restriction in ``<name>``, ``<value>`` and the like; None if there is none."""
    if holder is None:
        return None
    simple = _first(holder, "simpleValue")
    if simple is not None:
        value = _text(simple)
        return Simple(value) if value else None
    if len(holder) == 0:
        value = (holder.text or "").strip()
        return Simple(value) if value else None
    given = _first(holder, "restriction")
    if given is None:
        return None
    members = tuple(e.get("value") for e in _all(given, "enumeration") if e.get("value") is not None)
    if members:
        return OneOf(members)
    patterns = [e.get("value") for e in _all(given, "pattern") if e.get("value")]
    if patterns:
        return Pattern(patterns[0] if len(patterns) == 1 else "|".join(f"({p})" for p in patterns))
    length = Length(*(_number(_first(given, n)) for n in ("length", "minLength", "maxLength")))
    if length != Length():
        return length
    low_in, low_ex, high_in, high_ex = (_number(_first(given, n)) for n in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"))
    bounds = Bounds(low_ex if low_in is None else low_in, high_ex if high_in is None else high_in, low_in is not None, high_in is not None)
    return None if bounds == Bounds() else bounds


def _entity(element: ET.Element) -> Entity:
    return Entity(read_restriction(_first(element, "name")) or Simple(""), read_restriction(_first(element, "predefinedType")))


def _part_of(element: ET.Element) -> PartOf:
    whole = _first(element, "entity")
    return PartOf((element.get("relation") or "").upper(), _entity(whole) if whole is not None else None)


def _held(element: ET.Element, name: str) -> Restriction | None:
    return read_restriction(_first(element, name))


_READERS = {
    "entity": _entity,
    "attribute": lambda e: Attribute(_held(e, "name") or Simple(""), _held(e, "value")),
    "property": lambda e: Property(_held(e, "propertySet") or Simple(""), _held(e, "baseName") or Simple(""), _held(e, "value"), e.get("dataType")),
    "classification": lambda e: Classification(_held(e, "system"), _held(e, "value")),
    "material": lambda e: Material(_held(e, "value")),
    "partof": _part_of,
}


def read_facet(element: ET.Element) -> Facet:
    """A facet; an unknown one is an attribute without a name, which nothing has."""
    return _READERS.get(_name(element), lambda _: Attribute(Simple("")))(element)


def _facets(container: ET.Element | None) -> list[ET.Element]:
    return [e for e in (container if container is not None else ()) if _name(e) in _READERS]


def read_cardinality(element: ET.Element) -> str:
    said = (element.get("cardinality") or "").lower()
    if said in CARDINALITIES:
        return said
    if element.get("maxOccurs") == "0":
        return "prohibited"
    return "optional" if element.get("minOccurs") == "0" else "required"


def _specification(element: ET.Element, index: int) -> Specification:
    scope = _first(element, "applicability")
    versions = element.get("ifcVersion")
    return Specification(
        id=f"spec-{index}",
        name=element.get("name") if element.get("name") is not None else f"Specification {index + 1}",
        applicability=tuple(map(read_facet, _facets(scope))),
        requirements=tuple(Requirement(read_facet(e), read_cardinality(e)) for e in _facets(_first(element, "requirements"))),
        cardinality=read_cardinality(scope) if scope is not None else "required",
        description=element.get("description"),
        ifc_version=tuple(versions.split()) if versions else None,
    )


def parse_ids(xml: str | bytes, fallback_title: str = "IDS") -> Document:
    """Read a requirement document; RuleError if it is none."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        raise RuleError(f"IDS XML parse error: {error}") from error
    if _name(root) != "ids":
        raise RuleError(f"Not an IDS document (root element is <{_name(root)}>)")
    info = _first(root, "info")
    said = {n: _text(_first(info, n)) or None for n in ("title", "description", "author", "date")}
    specs = tuple(_specification(e, k) for k, e in enumerate(_all(_first(root, "specifications"), "specification")))
    return Document(said["title"] or fallback_title, specs, said["description"], said["author"], said["date"])
