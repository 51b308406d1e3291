"""Units of measure: SI prefixes and names, measure types, and the factor columns built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten of the SI prefixes.
SI_PREFIX = {
    "EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1,
    "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9, "PICO": 1e-12, "FEMTO": 1e-15, "ATTO": 1e-18,
}

# The unit type of each measure type. These are also the measures that are compared in SI units.
MEASURE_UNIT_TYPE = {
    "IFCABSORBEDDOSEMEASURE": "ABSORBEDDOSEUNIT",
    "IFCAMOUNTOFSUBSTANCEMEASURE": "AMOUNTOFSUBSTANCEUNIT",
    "IFCAREAMEASURE": "AREAUNIT",
    "IFCDOSEEQUIVALENTMEASURE": "DOSEEQUIVALENTUNIT",
    "IFCELECTRICCAPACITANCEMEASURE": "ELECTRICCAPACITANCEUNIT",
    "IFCELECTRICCHARGEMEASURE": "ELECTRICCHARGEUNIT",
    "IFCELECTRICCONDUCTANCEMEASURE": "ELECTRICCONDUCTANCEUNIT",
    "IFCELECTRICCURRENTMEASURE": "ELECTRICCURRENTUNIT",
    "IFCELECTRICRESISTANCEMEASURE": "ELECTRICRESISTANCEUNIT",
    "IFCELECTRICVOLTAGEMEASURE": "ELECTRICVOLTAGEUNIT",
    "IFCENERGYMEASURE": "ENERGYUNIT",
    "IFCFORCEMEASURE": "FORCEUNIT",
    "IFCFREQUENCYMEASURE": "FREQUENCYUNIT",
    "IFCILLUMINANCEMEASURE": "ILLUMINANCEUNIT",
    "IFCINDUCTANCEMEASURE": "INDUCTANCEUNIT",
    "IFCLENGTHMEASURE": "LENGTHUNIT",
    "IFCLUMINOUSFLUXMEASURE": "LUMINOUSFLUXUNIT",
    "IFCLUMINOUSINTENSITYMEASURE": "LUMINOUSINTENSITYUNIT",
    "IFCMAGNETICFLUXDENSITYMEASURE": "MAGNETICFLUXDENSITYUNIT",
    "IFCMAGNETICFLUXMEASURE": "MAGNETICFLUXUNIT",
    "IFCMASSMEASURE": "MASSUNIT",
    "IFCNONNEGATIVELENGTHMEASURE": "LENGTHUNIT",
    "IFCPLANARFORCEMEASURE": "PLANARFORCEUNIT",
    "IFCPLANEANGLEMEASURE": "PLANEANGLEUNIT",
    "IFCPOSITIVELENGTHMEASURE": "LENGTHUNIT",
    "IFCPOSITIVEPLANEANGLEMEASURE": "PLANEANGLEUNIT",
    "IFCPOWERMEASURE": "POWERUNIT",
    "IFCPRESSUREMEASURE": "PRESSUREUNIT",
    "IFCRADIOACTIVITYMEASURE": "RADIOACTIVITYUNIT",
    "IFCROTATIONALFREQUENCYMEASURE": "ROTATIONALFREQUENCYUNIT",
    "IFCSOLIDANGLEMEASURE": "SOLIDANGLEUNIT",
    "IFCSOUNDPOWERMEASURE": "SOUNDPOWERUNIT",
    "IFCSOUNDPRESSUREMEASURE": "SOUNDPRESSUREUNIT",
    "IFCTHERMALCONDUCTIVITYMEASURE": "THERMALCONDUCTANCEUNIT",
    "IFCTHERMALTRANSMITTANCEMEASURE": "THERMALTRANSMITTANCEUNIT",
    "IFCTHERMODYNAMICTEMPERATUREMEASURE": "THERMODYNAMICTEMPERATUREUNIT",
    "IFCTIMEMEASURE": "TIMEUNIT",
    "IFCVOLUMEMEASURE": "VOLUMEUNIT",
}

# The unit type of each quantity class; counts and numbers have none.
QUANTITY_UNIT_TYPE = {
    "IFCQUANTITYLENGTH": "LENGTHUNIT",
    "IFCQUANTITYAREA": "AREAUNIT",
    "IFCQUANTITYVOLUME": "VOLUMEUNIT",
    "IFCQUANTITYWEIGHT": "MASSUNIT",
    "IFCQUANTITYTIME": "TIMEUNIT",
}

# Unit names whose label is not the name with spaces.
SI_LABEL = {"LUMINOUS_FLUX": "LUMEN", "LUMINOUS_INTENSITY": "CANDELA"}


def lookup(table: dict, key: Column) -> Column:
    """The table's value for the key, null for other keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def si_factor(prefix: Column, name: Column) -> Column:
    """What one prefixed unit is in the plain SI unit; areas and volumes take the prefix squared and cubed."""
    power = F.when(name == "SQUARE_METRE", 2).when(name == "CUBIC_METRE", 3).otherwise(1)
    return F.pow(F.coalesce(lookup(SI_PREFIX, prefix), F.lit(1.0)), power)


def unit_label(prefix: Column, name: Column) -> Column:
    """``MILLIMETRE``, ``SQUARE MILLIMETRE``: the prefix goes to the last word."""
    words = F.coalesce(lookup(SI_LABEL, name), F.replace(name, F.lit("_"), F.lit(" ")))
    plain = F.regexp_extract(words, r"^(.* )?([^ ]*)$", 1)
    return F.concat(plain, F.coalesce(prefix, F.lit("")), F.regexp_extract(words, r"^(.* )?([^ ]*)$", 2))


def measure_unit_type(measure: Column) -> Column:
    """The unit type by the naming rule: IFCxMEASURE has xUNIT."""
    kind = F.regexp_extract(F.upper(measure), r"^IFC(.*)MEASURE$", 1)
    return F.when(kind != "", F.concat(kind, F.lit("UNIT")))
