"""Classes that describe shape, placement or styling; they are no nodes of the model graph."""

from __future__ import annotations

# Names of geometry and presentation classes, in alphabetical order.
GEOMETRY_CLASSES = tuple(
    """
    IFC2DCOMPOSITECURVE IFCADVANCEDBREP IFCADVANCEDBREPWITHVOIDS IFCADVANCEDFACE IFCANNOTATIONFILLAREA IFCARBITRARYCLOSEDPROFILEDEF
    IFCARBITRARYOPENPROFILEDEF IFCARBITRARYPROFILEDEFWITHVOIDS IFCASYMMETRICISHAPEPROFILEDEF IFCAXIS1PLACEMENT IFCAXIS2PLACEMENT2D IFCAXIS2PLACEMENT3D
    IFCAXIS2PLACEMENTLINEAR IFCBLOCK IFCBOOLEANCLIPPINGRESULT IFCBOOLEANRESULT IFCBOUNDARYCURVE IFCBOUNDINGBOX IFCBOXEDHALFSPACE
    IFCBSPLINECURVEWITHKNOTS IFCBSPLINESURFACEWITHKNOTS IFCCARTESIANPOINT IFCCARTESIANPOINTLIST2D IFCCARTESIANPOINTLIST3D
    IFCCARTESIANTRANSFORMATIONOPERATOR2D IFCCARTESIANTRANSFORMATIONOPERATOR2DNONUNIFORM IFCCARTESIANTRANSFORMATIONOPERATOR3D
    IFCCARTESIANTRANSFORMATIONOPERATOR3DNONUNIFORM IFCCENTERLINEPROFILEDEF IFCCIRCLE IFCCIRCLEHOLLOWPROFILEDEF IFCCIRCLEPROFILEDEF IFCCLOSEDSHELL
    IFCCLOTHOID IFCCOMPOSITECURVE IFCCOMPOSITECURVEONSURFACE IFCCOMPOSITECURVESEGMENT IFCCOMPOSITEPROFILEDEF IFCCONNECTEDFACESET IFCCOSINESPIRAL
    IFCCSGSOLID IFCCSHAPEPROFILEDEF IFCCURVEBOUNDEDPLANE IFCCURVEBOUNDEDSURFACE IFCCURVESEGMENT IFCCYLINDRICALSURFACE IFCDERIVEDPROFILEDEF
    IFCDIRECTION IFCDIRECTRIXDERIVEDREFERENCESWEPTAREASOLID IFCEDGE IFCEDGECURVE IFCEDGELOOP IFCELLIPSE IFCELLIPSEPROFILEDEF
    IFCEXTERNALLYDEFINEDHATCHSTYLE IFCEXTERNALLYDEFINEDSURFACESTYLE IFCEXTERNALLYDEFINEDTEXTFONT IFCEXTRUDEDAREASOLID IFCEXTRUDEDAREASOLIDTAPERED
    IFCFACE IFCFACEBASEDSURFACEMODEL IFCFACEBOUND IFCFACEOUTERBOUND IFCFACESURFACE IFCFACETEDBREP IFCFACETEDBREPWITHVOIDS IFCFILLAREASTYLEHATCHING
    IFCFILLAREASTYLETILES IFCFILLAREASTYLETILESYMBOLWITHSTYLE IFCFIXEDREFERENCESWEPTAREASOLID IFCGEOMETRICCURVESET IFCGEOMETRICREPRESENTATIONCONTEXT
    IFCGEOMETRICSET IFCGRADIENTCURVE IFCGRIDPLACEMENT IFCHALFSPACESOLID IFCINDEXEDPOLYCURVE IFCINDEXEDPOLYGONALFACE IFCINDEXEDPOLYGONALFACEWITHVOIDS
    IFCINDEXEDPOLYGONALTEXTUREMAP IFCINDEXEDTRIANGLETEXTUREMAP IFCINTERSECTIONCURVE IFCISHAPEPROFILEDEF IFCLIGHTSOURCEAMBIENT
    IFCLIGHTSOURCEDIRECTIONAL IFCLIGHTSOURCEGONIOMETRIC IFCLIGHTSOURCEPOSITIONAL IFCLIGHTSOURCESPOT IFCLINE IFCLINEARPLACEMENT IFCLOCALPLACEMENT
    IFCLOOP IFCLSHAPEPROFILEDEF IFCMAPPEDITEM IFCMATERIALDEFINITIONREPRESENTATION IFCMIRROREDPROFILEDEF IFCOFFSETCURVE2D IFCOFFSETCURVE3D
    IFCOFFSETCURVEBYDISTANCES IFCOPENCROSSPROFILEDEF IFCOPENSHELL IFCORIENTEDEDGE IFCOUTERBOUNDARYCURVE IFCPATH IFCPCURVE IFCPLANARBOX IFCPLANAREXTENT
    IFCPLANE IFCPOINTBYDISTANCEEXPRESSION IFCPOINTONCURVE IFCPOINTONSURFACE IFCPOLYGONALBOUNDEDHALFSPACE IFCPOLYGONALFACESET IFCPOLYLINE IFCPOLYLOOP
    IFCPOLYNOMIALCURVE IFCPRESENTATIONLAYERASSIGNMENT IFCPRESENTATIONLAYERWITHSTYLE IFCPRESENTATIONSTYLEASSIGNMENT IFCPRODUCTDEFINITIONSHAPE
    IFCPROFILEDEF IFCRATIONALBSPLINECURVEWITHKNOTS IFCRATIONALBSPLINESURFACEWITHKNOTS IFCRECTANGLEHOLLOWPROFILEDEF IFCRECTANGLEPROFILEDEF
    IFCRECTANGULARPYRAMID IFCRECTANGULARTRIMMEDSURFACE IFCREPARAMETRISEDCOMPOSITECURVESEGMENT IFCREPRESENTATIONMAP IFCREVOLVEDAREASOLID
    IFCREVOLVEDAREASOLIDTAPERED IFCRIGHTCIRCULARCONE IFCRIGHTCIRCULARCYLINDER IFCROUNDEDRECTANGLEPROFILEDEF IFCSEAMCURVE
    IFCSECONDORDERPOLYNOMIALSPIRAL IFCSECTIONEDSOLIDHORIZONTAL IFCSECTIONEDSPINE IFCSECTIONEDSURFACE IFCSEGMENTEDREFERENCECURVE
    IFCSEVENTHORDERPOLYNOMIALSPIRAL IFCSHAPEASPECT IFCSHAPEREPRESENTATION IFCSHELLBASEDSURFACEMODEL IFCSINESPIRAL IFCSPHERE IFCSPHERICALSURFACE
    IFCSTYLEDITEM IFCSTYLEDREPRESENTATION IFCSUBEDGE IFCSURFACECURVE IFCSURFACECURVESWEPTAREASOLID IFCSURFACEOFLINEAREXTRUSION IFCSURFACEOFREVOLUTION
    IFCSWEPTDISKSOLID IFCSWEPTDISKSOLIDPOLYGONAL IFCTEXTLITERAL IFCTEXTLITERALWITHEXTENT IFCTEXTURECOORDINATEGENERATOR IFCTEXTUREMAP
    IFCTHIRDORDERPOLYNOMIALSPIRAL IFCTOPOLOGYREPRESENTATION IFCTOROIDALSURFACE IFCTRAPEZIUMPROFILEDEF IFCTRIANGULATEDFACESET
    IFCTRIANGULATEDIRREGULARNETWORK IFCTRIMMEDCURVE IFCTSHAPEPROFILEDEF IFCTWODIRECTIONREPEATFACTOR IFCUSHAPEPROFILEDEF IFCVECTOR IFCVERTEX
    IFCVERTEXLOOP IFCVERTEXPOINT IFCZSHAPEPROFILEDEF
    """.split()
)

# Placement classes.
PLACEMENT_CLASSES = (
    "IFCLOCALPLACEMENT",
    "IFCGRIDPLACEMENT",
    "IFCLINEARPLACEMENT",
    "IFCAXIS2PLACEMENT3D",
    "IFCAXIS2PLACEMENT2D",
    "IFCAXIS2PLACEMENTLINEAR",
    "IFCAXIS1PLACEMENT",
    "IFCCARTESIANPOINT",
)
