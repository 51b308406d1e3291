"""Attribute names of classes, in argument order.

The table follows from the inheritance of the published schema: a row names a parent, the attributes that its classes add, and the
classes. Occurrence classes whose only own attribute is PredefinedType have a type class of the same name, so these are listed
once. Geometry, placement and relationship classes are no nodes of the model graph and are left out. A class that the table
of its schema lacks gets no names: its arguments are ``[n]``. Tables of other schemas follow from their EXPRESS text by
:func:`from_express`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cache

Table = Mapping[str, tuple[str, ...]]

# Parent, attributes that the classes add, classes of the published IFC4X3 schema (without the prefix Ifc).
_ROOTED = (
    ("", "GlobalId OwnerHistory Name Description", "Root"),
    ("Root", "ObjectType", "Object"),
    ("Object", "", "Group System"),
    ("Object", "LongName Phase RepresentationContexts UnitsInContext", "Project ProjectLibrary"),
    ("Object", "LongName", "Zone"),
    ("Object", "LongName PredefinedType", "DistributionSystem DistributionCircuit"),
    ("Object", "PredefinedType LongName", "BuildingSystem BuiltSystem"),
    ("Object", "TheActor", "Actor"),
    ("Actor", "PredefinedType", "Occupant"),
    ("Object", "Identification", "Control"),
    ("Control", "CreationDate Creators Purpose Duration TotalFloat StartTime FinishTime PredefinedType", "WorkPlan WorkSchedule"),
    ("Control", "LifeCyclePhase PredefinedType", "PerformanceHistory"),
    ("Control", "PredefinedType CostValues CostQuantities", "CostItem"),
    ("Control", "PredefinedType Status LongDescription", "ActionRequest Permit ProjectOrder"),
    ("Control", "PredefinedType Status SubmittedOn UpdateDate", "CostSchedule"),
    ("Control", "WorkingTimes ExceptionTimes PredefinedType", "WorkCalendar"),
    ("Control", "LongDescription", "Process"),
    ("Process", "PredefinedType", "Procedure"),
    ("Process", "PredefinedType EventTriggerType UserDefinedEventTriggerType EventOccurenceTime", "Event"),
    ("Process", "Status WorkMethod IsMilestone Priority TaskTime PredefinedType", "Task"),
    (
        "Process", "Usage BaseCosts BaseQuantity PredefinedType",
        "ConstructionEquipmentResource ConstructionMaterialResource ConstructionProductResource CrewResource LaborResource SubContractResource",
    ),
    ("Object", "Identification OriginalValue CurrentValue TotalReplacementCost Owner User ResponsiblePerson IncorporationDate DepreciatedValue", "Asset"),
    ("Object", "PredefinedType Jurisdiction ResponsiblePersons LastUpdateDate CurrentValue OriginalValue", "Inventory"),
    ("Object", "PredefinedType OrientationOf2DPlane LoadedBy HasResults SharedPlacement", "StructuralAnalysisModel"),
    ("Object", "PredefinedType ActionType ActionSource Coefficient Purpose", "StructuralLoadGroup"),
    ("StructuralLoadGroup", "SelfWeightCoefficients", "StructuralLoadCase"),
    ("Object", "TheoryType ResultForLoadGroup IsLinear", "StructuralResultGroup"),
    ("Object", "ObjectPlacement Representation", "Product"),
    ("Product", "", "AlignmentHorizontal AlignmentVertical LinearElement LinearPositioningElement"),
    ("Product", "PredefinedType", "Alignment Annotation Referent"),
    ("Product", "DesignParameters", "AlignmentSegment"),
    ("Product", "RailHeadDistance", "AlignmentCant"),
    ("Product", "UAxes VAxes WAxes PredefinedType", "Grid"),
    ("Product", "FlowDirection PredefinedType SystemType", "DistributionPort"),
    ("Product", "AppliedCondition", "StructuralSurfaceConnection"),
    ("Product", "AppliedCondition AxisDirection", "StructuralCurveConnection"),
    ("Product", "AppliedCondition ConditionCoordinateSystem", "StructuralPointConnection"),
    ("Product", "AppliedLoad GlobalOrLocal", "StructuralPointReaction"),
    ("StructuralPointReaction", "PredefinedType", "StructuralCurveReaction StructuralSurfaceReaction"),
    ("StructuralPointReaction", "DestabilizingLoad", "StructuralPointAction"),
    ("StructuralPointAction", "ProjectedOrTrue PredefinedType", "StructuralCurveAction StructuralLinearAction StructuralPlanarAction StructuralSurfaceAction"),
    ("Product", "PredefinedType Axis", "StructuralCurveMember StructuralCurveMemberVarying"),
    ("Product", "PredefinedType Thickness", "StructuralSurfaceMember StructuralSurfaceMemberVarying"),
    ("Product", "LongName", "SpatialElement"),
    ("SpatialElement", "PredefinedType", "ExternalSpatialElement SpatialZone"),
    ("SpatialElement", "CompositionType", "Facility"),
    ("Facility", "RefLatitude RefLongitude RefElevation LandTitleNumber SiteAddress", "Site"),
    ("Facility", "ElevationOfRefHeight ElevationOfTerrain BuildingAddress", "Building"),
    ("Facility", "Elevation", "BuildingStorey"),
    ("Facility", "PredefinedType ElevationWithFlooring", "Space"),
    ("Facility", "PredefinedType", "Bridge MarineFacility Railway Road"),
    ("Facility", "UsageType PredefinedType", "BridgePart FacilityPartCommon MarinePart RailwayPart RoadPart"),
    ("Product", "Tag", "Element"),
    (
        "Element", "",
        "Borehole BuiltElement CivilElement DeepFoundation DistributionControlElement DistributionElement DistributionFlowElement EarthworksElement EnergyConversionDevice "
        "FlowController FlowFitting FlowMovingDevice FlowSegment FlowStorageDevice FlowTerminal FlowTreatmentDevice FurnishingElement Geomodel Geoslice",
    ),
    ("Element", "PredefinedType", "EarthworksCut EarthworksFill GeotechnicalStratum OpeningElement ProjectionElement ReinforcedSoil SurfaceFeature VirtualElement VoidingFeature WallStandardCase"),
    ("Element", "AssemblyPlace PredefinedType", "ElementAssembly"),
    ("Element", "PredefinedType", "Furniture"),
    ("Element", "PredefinedType ConstructionType", "Pile"),
    ("Element", "NominalDiameter NominalLength PredefinedType", "MechanicalFastener"),
    ("Element", "NumberOfRisers NumberOfTreads RiserHeight TreadLength PredefinedType", "StairFlight"),
    ("Element", "OverallHeight OverallWidth PredefinedType OperationType UserDefinedOperationType", "Door"),
    ("Element", "OverallHeight OverallWidth PredefinedType PartitioningType UserDefinedPartitioningType", "Window"),
    ("Element", "SteelGrade", "ReinforcingElement"),
    ("ReinforcingElement", "NominalDiameter CrossSectionArea BarLength PredefinedType BarSurface", "ReinforcingBar"),
    (
        "ReinforcingElement",
        "MeshLength MeshWidth LongitudinalBarNominalDiameter TransverseBarNominalDiameter LongitudinalBarCrossSectionArea TransverseBarCrossSectionArea LongitudinalBarSpacing "
        "TransverseBarSpacing PredefinedType",
        "ReinforcingMesh",
    ),
    ("ReinforcingElement", "PredefinedType NominalDiameter CrossSectionArea TensionForce PreStress FrictionCoefficient AnchorageSlip MinCurvatureRadius", "Tendon"),
    ("ReinforcingElement", "PredefinedType", "TendonAnchor TendonConduit"),
    ("Root", "ApplicableOccurrence HasPropertySets", "TypeObject"),
    ("TypeObject", "Identification LongDescription ProcessType", "TypeProcess"),
    ("TypeProcess", "PredefinedType", "ProcedureType"),
    ("TypeProcess", "PredefinedType EventTriggerType UserDefinedEventTriggerType", "EventType"),
    ("TypeProcess", "PredefinedType WorkMethod", "TaskType"),
    (
        "TypeObject", "Identification LongDescription ResourceType BaseCosts BaseQuantity PredefinedType",
        "ConstructionEquipmentResourceType ConstructionMaterialResourceType ConstructionProductResourceType CrewResourceType LaborResourceType SubContractResourceType",
    ),
    ("TypeObject", "RepresentationMaps Tag", "TypeProduct"),
    ("TypeProduct", "ElementType", "ElementType"),
    ("ElementType", "", "BuiltElementType CivilElementType DeepFoundationType DistributionElementType FurnishingElementType"),
    ("ElementType", "AssemblyPlace PredefinedType", "FurnitureType"),
    ("ElementType", "PredefinedType", "ElementAssemblyType PileType StairFlightType TendonAnchorType TendonConduitType"),
    ("ElementType", "PredefinedType LongName", "SpaceType SpatialZoneType"),
    ("ElementType", "PredefinedType OperationType ParameterTakesPrecedence UserDefinedOperationType", "DoorType"),
    ("ElementType", "PredefinedType PartitioningType ParameterTakesPrecedence UserDefinedPartitioningType", "WindowType"),
    ("ElementType", "PredefinedType NominalDiameter NominalLength", "MechanicalFastenerType"),
    ("ElementType", "PredefinedType NominalDiameter CrossSectionArea BarLength BarSurface BendingShapeCode BendingParameters", "ReinforcingBarType"),
    (
        "ElementType",
        "PredefinedType MeshLength MeshWidth LongitudinalBarNominalDiameter TransverseBarNominalDiameter LongitudinalBarCrossSectionArea TransverseBarCrossSectionArea "
        "LongitudinalBarSpacing TransverseBarSpacing BendingShapeCode BendingParameters",
        "ReinforcingMeshType",
    ),
    ("ElementType", "PredefinedType NominalDiameter CrossSectionArea SheathDiameter", "TendonType"),
    ("Root", "HasProperties", "PropertySet"),
    ("Root", "MethodOfMeasurement Quantities", "ElementQuantity"),
    ("Root", "TemplateType ApplicableEntity HasPropertyTemplates", "PropertySetTemplate"),
    ("Root", "TemplateType PrimaryMeasureType SecondaryMeasureType Enumerators PrimaryUnit SecondaryUnit Expression AccessState", "SimplePropertyTemplate"),
    ("Root", "UsageName TemplateType HasPropertyTemplates", "ComplexPropertyTemplate"),
    ("Root", "DefinitionType ReinforcementSectionDefinitions", "ReinforcementDefinitionProperties"),
    (
        "Root",
        "LiningDepth LiningThickness ThresholdDepth ThresholdThickness TransomThickness TransomOffset LiningOffset ThresholdOffset CasingThickness CasingDepth ShapeAspectStyle "
        "LiningToPanelOffsetX LiningToPanelOffsetY",
        "DoorLiningProperties",
    ),
    (
        "Root",
        "LiningDepth LiningThickness TransomThickness MullionThickness FirstTransomOffset SecondTransomOffset FirstMullionOffset SecondMullionOffset ShapeAspectStyle LiningOffset "
        "LiningToPanelOffsetX LiningToPanelOffsetY",
        "WindowLiningProperties",
    ),
    ("Root", "OperationType PanelPosition FrameDepth FrameThickness ShapeAspectStyle", "PermeableCoveringProperties WindowPanelProperties"),
    ("Root", "PanelDepth PanelOperation PanelWidth PanelPosition ShapeAspectStyle", "DoorPanelProperties"),
)

# Element classes that add PredefinedType alone, as their type classes do, in alphabetical order.
_PAIRED = """
Actuator AirTerminal AirTerminalBox AirToAirHeatRecovery Alarm AudioVisualAppliance Beam Bearing Boiler BuildingElementPart BuildingElementProxy Burner CableCarrierFitting
CableCarrierSegment CableFitting CableSegment CaissonFoundation Chiller Chimney Coil Column CommunicationsAppliance Compressor Condenser Controller ConveyorSegment CooledBeam
CoolingTower Course Covering CurtainWall Damper DiscreteAccessory DistributionBoard DistributionChamberElement DuctFitting DuctSegment DuctSilencer ElectricAppliance
ElectricDistributionBoard ElectricFlowStorageDevice ElectricFlowTreatmentDevice ElectricGenerator ElectricMotor ElectricTimeControl Engine EvaporativeCooler Evaporator Fan
Fastener Filter FireSuppressionTerminal FlowInstrument FlowMeter Footing GeographicElement HeatExchanger Humidifier ImpactProtectionDevice Interceptor JunctionBox Kerb Lamp
LightFixture LiquidTerminal MedicalDevice Member MobileTelecommunicationsAppliance MooringDevice MotorConnection NavigationElement Outlet Pavement PipeFitting PipeSegment Plate
ProtectiveDevice ProtectiveDeviceTrippingUnit Pump Rail Railing Ramp RampFlight Roof SanitaryTerminal Sensor ShadingDevice Sign Signal Slab SolarDevice SpaceHeater StackTerminal
Stair SwitchingDevice SystemFurnitureElement Tank TrackElement Transformer TransportElement TubeBundle UnitaryControlElement UnitaryEquipment Valve Vehicle VibrationDamper
VibrationIsolator Wall WasteTerminal
"""

# Parent, attributes that the classes add, classes without a global id of the published IFC4X3 schema.
_RESOURCES = (
    ("", "ApplicationDeveloper Version ApplicationFullName ApplicationIdentifier", "Application"),
    ("", "OwningUser OwningApplication State ChangeAction LastModifiedDate LastModifyingUser LastModifyingApplication CreationDate", "OwnerHistory"),
    ("", "Identification FamilyName GivenName MiddleNames PrefixTitles SuffixTitles Roles Addresses", "Person"),
    ("", "Identification Name Description Roles Addresses", "Organization"),
    ("", "ThePerson TheOrganization Roles", "PersonAndOrganization"),
    ("", "Role UserDefinedRole Description", "ActorRole"),
    ("", "Purpose Description UserDefinedPurpose", "Address"),
    ("Address", "InternalLocation AddressLines PostalBox Town Region PostalCode Country", "PostalAddress"),
    ("Address", "TelephoneNumbers FacsimileNumbers PagerNumber ElectronicMailAddresses WWWHomePageURL MessagingIDs", "TelecomAddress"),
    ("", "Name", "Named DraughtingPreDefinedColour DraughtingPreDefinedCurveFont"),
    ("Named", "Description", "Described"),
    ("Described", "RelatingOrganization RelatedOrganizations", "OrganizationRelationship"),
    ("Described", "RelatingApproval RelatedApprovals", "ApprovalRelationship"),
    ("Described", "RelatedResourceObjects RelatingApproval", "ResourceApprovalRelationship"),
    ("Described", "RelatingConstraint RelatedResourceObjects", "ResourceConstraintRelationship"),
    ("Described", "RelatingReference RelatedResourceObjects", "ExternalReferenceRelationship"),
    ("Described", "RelatingDocument RelatedDocuments RelationshipType", "DocumentInformationRelationship"),
    ("Described", "RelatingMaterial RelatedMaterials MaterialExpression", "MaterialRelationship"),
    ("Described", "RelatingMonetaryUnit RelatedMonetaryUnit ExchangeRate RateDateTime RateSource", "CurrencyRelationship"),
    ("Described", "DependingProperty DependantProperty Expression", "PropertyDependencyRelationship"),
    ("", "Identifier Name Description TimeOfApproval Status Level Qualifier RequestingApproval GivingApproval", "Approval"),
    ("Described", "ConstraintGrade ConstraintSource CreatingActor CreationTime UserDefinedGrade", "Constraint"),
    ("Constraint", "Benchmark ValueSource DataValue ReferencePath", "Metric"),
    ("Constraint", "BenchmarkValues LogicalAggregator ObjectiveQualifier UserDefinedQualifier", "Objective"),
    ("Described", "AppliedValue UnitBasis ApplicableDate FixedUntilDate Category Condition ArithmeticOperator Components", "AppliedValue CostValue"),
    ("Described", "GeodeticDatum PrimeMeridian AngleUnit HeightUnit", "GeographicCRS"),
    ("Described", "GeodeticDatum VerticalDatum MapProjection MapZone MapUnit", "ProjectedCRS"),
    ("", "SourceCRS TargetCRS", "CoordinateOperation"),
    ("CoordinateOperation", "Eastings Northings OrthogonalHeight XAxisAbscissa XAxisOrdinate Scale", "MapConversion"),
    ("MapConversion", "FactorX FactorY FactorZ", "MapConversionScaled"),
    ("CoordinateOperation", "FirstCoordinate SecondCoordinate Height", "RigidOperation"),
    ("", "WellKnownText CoordinateReferenceSystem", "WellKnownText"),
    ("Named", "Specification", "Property"),
    ("Property", "NominalValue Unit", "PropertySingleValue"),
    ("Property", "EnumerationValues EnumerationReference", "PropertyEnumeratedValue"),
    ("Property", "ListValues Unit", "PropertyListValue"),
    ("Property", "UpperBoundValue LowerBoundValue Unit SetPointValue", "PropertyBoundedValue"),
    ("Property", "DefiningValues DefinedValues Expression DefiningUnit DefinedUnit CurveInterpolation", "PropertyTableValue"),
    ("Property", "UsageName PropertyReference", "PropertyReferenceValue"),
    ("Property", "UsageName HasProperties", "ComplexProperty"),
    ("Named", "EnumerationValues Unit", "PropertyEnumeration"),
    ("Described", "Properties Material", "MaterialProperties"),
    ("Described", "Properties ProfileDefinition", "ProfileProperties"),
    ("Described", "HasQuantities Discrimination Quality Usage", "PhysicalComplexQuantity"),
    *(("Described", f"Unit {kind}Value Formula", f"Quantity{kind}") for kind in ("Area", "Count", "Length", "Number", "Time", "Volume", "Weight")),
    ("", "Dimensions UnitType", "NamedUnit"),
    ("NamedUnit", "Prefix Name", "SIUnit"),
    ("NamedUnit", "Name", "ContextDependentUnit"),
    ("ContextDependentUnit", "ConversionFactor", "ConversionBasedUnit"),
    ("ConversionBasedUnit", "ConversionOffset", "ConversionBasedUnitWithOffset"),
    ("", "Elements UnitType UserDefinedType Name", "DerivedUnit"),
    ("", "Unit Exponent", "DerivedUnitElement"),
    ("", "Currency", "MonetaryUnit"),
    ("", "Units", "UnitAssignment"),
    ("", "ValueComponent UnitComponent", "MeasureWithUnit"),
    ("", "LengthExponent MassExponent TimeExponent ElectricCurrentExponent ThermodynamicTemperatureExponent AmountOfSubstanceExponent LuminousIntensityExponent", "DimensionalExponents"),
    ("Described", "Category", "Material"),
    ("", "Material LayerThickness IsVentilated Name Description Category Priority", "MaterialLayer"),
    ("MaterialLayer", "OffsetDirection OffsetValues", "MaterialLayerWithOffsets"),
    ("", "MaterialLayers LayerSetName Description", "MaterialLayerSet"),
    ("", "ForLayerSet LayerSetDirection DirectionSense OffsetFromReferenceLine ReferenceExtent", "MaterialLayerSetUsage"),
    ("Described", "Material Fraction Category", "MaterialConstituent"),
    ("Described", "MaterialConstituents", "MaterialConstituentSet"),
    ("Described", "Material Profile Priority Category", "MaterialProfile"),
    ("MaterialProfile", "OffsetValues", "MaterialProfileWithOffsets"),
    ("Described", "MaterialProfiles CompositeProfile", "MaterialProfileSet"),
    ("", "ForProfileSet CardinalPoint ReferenceExtent", "MaterialProfileSetUsage"),
    ("MaterialProfileSetUsage", "ForProfileEndSet CardinalEndPoint", "MaterialProfileSetUsageTapering"),
    ("", "Materials", "MaterialList"),
    ("", "MaterialClassifications ClassifiedMaterial", "MaterialClassificationRelationship"),
    ("", "Source Edition EditionDate Name Description Specification ReferenceTokens", "Classification"),
    ("", "Location Identification Name", "ExternalReference"),
    ("ExternalReference", "ReferencedSource Description Sort", "ClassificationReference"),
    ("ExternalReference", "Description ReferencedDocument", "DocumentReference"),
    ("ExternalReference", "Description Language ReferencedLibrary", "LibraryReference"),
    ("", "Name Version Publisher VersionDate Location Description", "LibraryInformation"),
    (
        "",
        "Identification Name Description Location Purpose IntendedUse Scope Revision DocumentOwner Editors CreationTime LastRevisionTime ElectronicFormat ValidFrom ValidUntil "
        "Confidentiality Status",
        "DocumentInformation",
    ),
    ("", "TypeIdentifier AttributeIdentifier InstanceName ListPositions InnerReference", "Reference"),
    ("Named", "Rows Columns", "Table"),
    ("", "RowCells IsHeading", "TableRow"),
    ("", "Identifier Name Description Unit ReferencePath", "TableColumn"),
    ("Described", "StartTime EndTime TimeSeriesDataType DataOrigin UserDefinedDataOrigin Unit", "TimeSeries"),
    ("TimeSeries", "TimeStep Values", "RegularTimeSeries"),
    ("TimeSeries", "Values", "IrregularTimeSeries"),
    ("", "ListValues", "TimeSeriesValue"),
    ("", "TimeStamp ListValues", "IrregularTimeSeriesValue"),
    ("", "StartTime EndTime", "TimePeriod"),
    ("", "RecurrenceType DayComponent WeekdayComponent MonthComponent Position Interval Occurrences TimePeriods", "RecurrencePattern"),
    ("Named", "DataOrigin UserDefinedDataOrigin", "SchedulingTime"),
    ("SchedulingTime", "ActualDate EarlyDate LateDate ScheduleDate", "EventTime"),
    ("SchedulingTime", "LagValue DurationType", "LagTime"),
    ("SchedulingTime", "RecurrencePattern StartDate FinishDate", "WorkTime"),
    (
        "SchedulingTime",
        "DurationType ScheduleDuration ScheduleStart ScheduleFinish EarlyStart EarlyFinish LateStart LateFinish FreeFloat TotalFloat IsCritical StatusTime ActualDuration ActualStart "
        "ActualFinish RemainingTime Completion",
        "TaskTime",
    ),
    ("TaskTime", "Recurrence", "TaskTimeRecurring"),
    (
        "SchedulingTime",
        "ScheduleWork ScheduleUsage ScheduleStart ScheduleFinish ScheduleContour LevelingDelay IsOverAllocated StatusTime ActualWork ActualUsage ActualStart ActualFinish "
        "RemainingWork RemainingUsage Completion",
        "ResourceTime",
    ),
    ("Named", "ForceX ForceY ForceZ MomentX MomentY MomentZ", "StructuralLoadSingleForce"),
    ("StructuralLoadSingleForce", "WarpingMoment", "StructuralLoadSingleForceWarping"),
    ("Named", "LinearForceX LinearForceY LinearForceZ LinearMomentX LinearMomentY LinearMomentZ", "StructuralLoadLinearForce"),
    ("Named", "PlanarForceX PlanarForceY PlanarForceZ", "StructuralLoadPlanarForce"),
    ("Named", "DisplacementX DisplacementY DisplacementZ RotationalDisplacementRX RotationalDisplacementRY RotationalDisplacementRZ", "StructuralLoadSingleDisplacement"),
    ("StructuralLoadSingleDisplacement", "Distortion", "StructuralLoadSingleDisplacementDistortion"),
    ("Named", "DeltaTConstant DeltaTY DeltaTZ", "StructuralLoadTemperature"),
    ("Named", "Values Locations", "StructuralLoadConfiguration"),
    ("Named", "SlippageX SlippageY SlippageZ", "SlippageConnectionCondition"),
    ("Named", "TensionFailureX TensionFailureY TensionFailureZ CompressionFailureX CompressionFailureY CompressionFailureZ", "FailureConnectionCondition"),
    ("Named", "SurfaceReinforcement1 SurfaceReinforcement2 ShearReinforcement", "SurfaceReinforcementArea"),
    ("Named", "TranslationalStiffnessByAreaX TranslationalStiffnessByAreaY TranslationalStiffnessByAreaZ", "BoundaryFaceCondition"),
    (
        "Named",
        "TranslationalStiffnessByLengthX TranslationalStiffnessByLengthY TranslationalStiffnessByLengthZ RotationalStiffnessByLengthX RotationalStiffnessByLengthY "
        "RotationalStiffnessByLengthZ",
        "BoundaryEdgeCondition",
    ),
    ("Named", "TranslationalStiffnessX TranslationalStiffnessY TranslationalStiffnessZ RotationalStiffnessX RotationalStiffnessY RotationalStiffnessZ", "BoundaryNodeCondition"),
    ("BoundaryNodeCondition", "WarpingStiffness", "BoundaryNodeConditionWarping"),
    ("", "LongitudinalStartPosition LongitudinalEndPosition TransversePosition ReinforcementRole SectionDefinition CrossSectionReinforcementDefinitions", "SectionReinforcementProperties"),
    ("", "SectionType StartProfile EndProfile", "SectionProperties"),
    ("", "TotalCrossSectionArea SteelGrade BarSurface EffectiveDepth NominalBarDiameter BarCount", "ReinforcementBarProperties"),
    ("", "PointOnRelatingElement PointOnRelatedElement", "ConnectionPointGeometry"),
    ("ConnectionPointGeometry", "EccentricityInX EccentricityInY EccentricityInZ", "ConnectionPointEccentricity"),
    *(("", f"{kind}OnRelatingElement {kind}OnRelatedElement", f"Connection{kind}Geometry") for kind in ("Curve", "Surface", "Volume")),
    ("", "AxisTag AxisCurve SameSense", "GridAxis"),
    ("", "IntersectingAxes OffsetDistances", "VirtualGridIntersection"),
    ("", "StartTag EndTag", "AlignmentParameterSegment"),
    ("AlignmentParameterSegment", "StartDistAlong HorizontalLength StartCantLeft EndCantLeft StartCantRight EndCantRight PredefinedType", "AlignmentCantSegment"),
    ("AlignmentParameterSegment", "StartDistAlong HorizontalLength StartHeight StartGradient EndGradient RadiusOfCurvature PredefinedType", "AlignmentVerticalSegment"),
    (
        "AlignmentParameterSegment",
        "StartPoint StartDirection StartRadiusOfCurvature EndRadiusOfCurvature SegmentLength GravityCenterLineHeight PredefinedType",
        "AlignmentHorizontalSegment",
    ),
    ("", "ParentContext TargetScale TargetView UserDefinedTargetView", "GeometricRepresentationSubContext"),
)

# Presentation classes that stay nodes of the graph.
_PRESENTATION = (
    ("Named", "Red Green Blue", "ColourRgb"),
    ("", "ColourList", "ColourRgbList"),
    ("Named", "Side Styles", "SurfaceStyle"),
    ("", "SurfaceColour Transparency", "SurfaceStyleShading"),
    ("SurfaceStyleShading", "DiffuseColour TransmissionColour DiffuseTransmissionColour ReflectionColour SpecularColour SpecularHighlight ReflectanceMethod", "SurfaceStyleRendering"),
    ("", "DiffuseTransmissionColour DiffuseReflectionColour TransmissionColour ReflectanceColour", "SurfaceStyleLighting"),
    ("", "RefractionIndex DispersionFactor", "SurfaceStyleRefraction"),
    ("", "Textures", "SurfaceStyleWithTextures"),
    ("Named", "CurveFont CurveWidth CurveColour ModelOrDraughting", "CurveStyle"),
    ("Named", "PatternList", "CurveStyleFont"),
    ("Named", "CurveStyleFont CurveFontScaling", "CurveStyleFontAndScaling"),
    ("", "VisibleSegmentLength InvisibleSegmentLength", "CurveStyleFontPattern"),
    ("Named", "FillStyles ModelOrDraughting", "FillAreaStyle"),
    ("Named", "TextCharacterAppearance TextStyle TextFontStyle ModelOrDraughting", "TextStyle"),
    ("", "Colour BackgroundColour", "TextStyleForDefinedFont"),
    ("", "TextIndent TextAlign TextDecoration LetterSpacing WordSpacing TextTransform LineHeight", "TextStyleTextModel"),
    ("Named", "FontFamily FontStyle FontVariant FontWeight FontSize", "TextStyleFontModel"),
    ("", "RepeatS RepeatT Mode TextureTransform Parameter", "SurfaceTexture"),
    ("SurfaceTexture", "RasterFormat RasterCode", "BlobTexture"),
    ("SurfaceTexture", "URLReference", "ImageTexture"),
    ("SurfaceTexture", "Width Height ColourComponents Pixel", "PixelTexture"),
    ("", "Coordinates", "TextureVertex"),
    ("", "TexCoordsList", "TextureVertexList"),
    ("", "TexCoordIndex TexCoordsOf", "TextureCoordinateIndices"),
    ("TextureCoordinateIndices", "InnerTexCoordIndices", "TextureCoordinateIndicesWithVoids"),
    ("", "MappedTo Opacity Colours ColourIndex", "IndexedColourMap"),
    ("", "OuterBoundary InnerBoundaries", "AnnotationFillArea"),
    ("", "LightDistributionCurve DistributionData", "LightIntensityDistribution"),
    ("", "MainPlaneAngle SecondaryPlaneAngle LuminousIntensity", "LightDistributionData"),
)

# What classes of the published IFC2X3 schema have in other places or under other names.
_IFC2X3 = (
    ("Facility", "InteriorOrExteriorSpace ElevationWithFlooring", "Space"),
    ("Element", "OverallHeight OverallWidth", "Door Window"),
    ("Element", "NumberOfRiser NumberOfTreads RiserHeight TreadLength", "StairFlight"),
    ("Element", "ShapeType", "Roof Ramp Stair"),
    ("Element", "", "Beam BuildingElementPart Column CurtainWall Fastener Member OpeningElement Plate ProjectionElement RampFlight VirtualElement Wall WallStandardCase"),
    ("Element", "NominalDiameter NominalLength", "MechanicalFastener"),
    ("Element", "CompositionType", "BuildingElementProxy"),
    ("ReinforcingElement", "NominalDiameter CrossSectionArea BarLength BarRole BarSurface", "ReinforcingBar"),
    ("TypeProduct", "OperationType ConstructionType ParameterTakesPrecedence Sizeable", "DoorStyle"),
    ("TypeProduct", "ConstructionType OperationType ParameterTakesPrecedence Sizeable", "WindowStyle"),
    ("", "Location ItemReference Name", "DocumentReference LibraryReference"),
    ("", "Location ItemReference Name ReferencedSource", "ClassificationReference"),
    ("", "Source Edition EditionDate Name", "Classification"),
    ("", "Name", "Material"),
    ("", "Material LayerThickness IsVentilated", "MaterialLayer"),
    ("", "MaterialLayers LayerSetName", "MaterialLayerSet"),
    ("", "Id FamilyName GivenName MiddleNames PrefixTitles SuffixTitles Roles Addresses", "Person"),
    ("", "Id Name Description Roles Addresses", "Organization"),
)

LATEST = "IFC4X3"


@cache
def tables() -> dict[str, Table]:
    """The built-in tables: class to attribute names by schema."""
    own: dict[str, tuple[str, ...]] = {"": ()}

    def add(rows, table: dict[str, tuple[str, ...]]) -> None:
        for parent, attributes, classes in rows:
            for name in classes.split():
                table[name.upper()] = (*(table.get(parent.upper()) or own[parent.upper()]), *attributes.split())

    for rows in (_ROOTED, _RESOURCES, _PRESENTATION):
        add(rows, own)
    add([(parent, "PredefinedType", " ".join(name + ending for name in _PAIRED.split())) for parent, ending in (("Element", ""), ("ElementType", "Type"))], own)
    older: dict[str, tuple[str, ...]] = {}
    add(_IFC2X3, older)
    latest = {f"IFC{name}": names for name, names in own.items() if name}
    return {LATEST: latest, "IFC2X3": {**latest, **{f"IFC{name}": names for name, names in older.items()}}}


def table_of(schema: str | None, given: Mapping[str, Table] | None = None) -> Table:
    """The table of a schema: one that is given for it, else the built-in one; any other schema has the latest one's."""
    known = {**tables(), **(given or {})}
    return known.get((schema or "").upper(), known[LATEST])


def from_express(text: str) -> dict[str, tuple[str, ...]]:
    """The table of an EXPRESS schema: own attributes behind those of the supertypes; derived ones keep their place."""
    own: dict[str, tuple[str | None, tuple[str, ...]]] = {}
    for found in re.finditer(r"(?is)\bENTITY\s+(\w+)(.*?)END_ENTITY\s*;", re.sub(r"(?s)\(\*.*?\*\)", "", text)):
        head, _, body = found[2].partition(";")
        parent = re.search(r"(?is)SUBTYPE\s+OF\s*\(\s*(\w+)", head)
        plain = re.split(r"(?i)\b(?:DERIVE|INVERSE|UNIQUE|WHERE)\b", body)[0]
        names = re.findall(r"(?m)^\s*(\w+)\s*:", plain)
        own[found[1].upper()] = (parent[1].upper() if parent else None, tuple(names))

    def whole(name: str | None) -> tuple[str, ...]:
        if name is None or name not in own:
            return ()
        return (*whole(own[name][0]), *own[name][1])

    return {name: whole(name) for name in own}
