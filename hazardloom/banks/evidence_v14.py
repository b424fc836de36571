"""Evidence bank v1.4: the v1.5 hazards without pedestrians, tighter gaps, two wider pathways."""

from hazardloom.banks import evidence_v15

HAZARDS = {
    name: [p for p in patterns if p != r"\bpedestrian\b"] for name, patterns in evidence_v15.HAZARDS.items()
}

# Patterns per category, tried in this order.
EXPOSURES = {
    "chemical_exposure": [
        r"\binhal",
        r"\bfume",
        r"\bvapou?r",
        r"\bchemical exposure\b",
        r"\bchemical\b.{0,80}\b(?:skin|eye|face|mouth|lip|shoulder|body)\b",
        r"\b(?:skin|eye|face|mouth|lip|shoulder|body)\b.{0,80}\b(?:chemical|solvent|acid|thinner|paint)\b",
    ],
    "thermal_exposure": [
        r"\bburn(?:ed|ing)?\b",
        r"\bscald(?:ed|ing)?\b",
        r"\bhot\b.{0,80}\b(?:contact|skin|body|burn)\b",
        r"\bsteam\b.{0,80}\b(?:contact|skin|body|burn)\b",
        r"\bredness\b.{0,60}\bburning\b",
    ],
    "electrical_exposure": [
        r"\belectric shock\b",
        r"\b(?:received|suffered|got)\b.{0,40}\belectric(?:al)?\b",
        r"\benergized\b.{0,60}\b(?:contact|touched|shock)\b",
        r"\bcontact\b.{0,60}\benergized\b",
    ],
    "vehicle_exposure": [
        r"\bvehicle exposure\b",
        r"\bpedestrian\b",
        r"\b(?:hit|struck|collision|collid|ran over|run over)\b.{0,80}\b(?:vehicle|truck|forklift|crane|loader|excavator)\b",
        r"\b(?:vehicle|truck|forklift|crane|loader|excavator)\b.{0,80}\b(?:hit|struck|collision|collid|ran over|run over)\b",
        r"\b(?:vehicle|truck|forklift|crane|loader|excavator)\b.{0,60}\bperson(?:nel)?\b",
    ],
    "fall_exposure": [
        r"\bfell\b",
        r"\bfall(?:ing)?\b.{0,60}\b(?:from|off)\b",
        r"\b(?:from|off)\b.{0,60}\b(?:height|platform|scaffold|tower|ladder)\b",
    ],
    "line_of_fire": [
        r"\bline of fire\b",
        r"\bstruck by\b",
        r"\bin the path\b",
        r"\btrajectory\b",
        r"\bpath of\b.{0,50}\b(?:flow|object|vehicle|material)\b",
    ],
    "caught_between_exposure": [
        r"\bpinch\b",
        r"\bcaught\b.{0,50}\b(?:between|in|inside)\b",
        r"\btrapped\b.{0,50}\b(?:between|in|inside)\b",
        r"\bcrush(?:ed|ing)?\b",
    ],
    "direct_contact": [r"\bcontact(?:ed)?\b", r"\btouched\b", r"\bprojected onto\b", r"\bsplashed\b"],
}

NOT_AN_EXPOSURE = "direct_contact"

PATHWAYS = {
    "electrical_contact": ("electrical_exposure", ["electrical"]),
    "chemical_release_exposure": (
        EXPOSURES["chemical_exposure"]
        + [
            r"\b(?:chemical|solvent|acid|caustic|thinner|paint)\b.{0,100}\b(?:spill|leak|release|splash|projected)\b",
            r"\b(?:spill|leak|release|splash|projected)\b.{0,100}\b(?:chemical|solvent|acid|caustic|thinner|paint)\b",
        ],
        ["chemical"],
    ),
    "thermal_contact": ("thermal_exposure", ["thermal"]),
    "fall_from_height": (
        EXPOSURES["fall_exposure"]
        + [r"\bfell\b", r"\bfall\b.{0,60}\b(?:height|platform|scaffold|tower|ladder)\b"],
        ["fall_height"],
    ),
    "struck_by_projectile": (
        [
            r"\bstruck by\b",
            r"\bproject(?:ile|ed)\b.{0,80}\b(?:hit|strike|person|worker)\b",
            r"\beject(?:ed|ion)\b.{0,80}\b(?:hit|strike|person|worker)\b",
            r"\bfalling object\b.{0,80}\b(?:hit|strike|person|worker)\b",
        ],
        ["stored_projectile", "mechanical", "pressure"],
    ),
    "caught_crush": ("caught_between_exposure", ["mechanical"]),
    "vehicle_person_collision": ("vehicle_exposure", ["vehicle"]),
}

CONTEXT = {
    "water_mud": [r"\bwater\b", r"\bmud\b"],
    "no_person_affected": [
        r"\bno presence of personnel\b",
        r"\bno personnel\b.{0,60}\b(?:affected|injur)\b",
        r"\bno one\b.{0,60}\b(?:affected|injur)\b",
    ],
    "deenergized_disabled": [r"\bde[- ]?energized\b", r"\bdisabled\b"],
    "protective_equipment": [r"\b(?:ppe|ep[pi]s?)\b", r"\bsafety belt\b", r"\bseat belt\b"],
    "distance_context": [r"\b\d+\s*(?:m|meter|meters)\b", r"\bdistance\b"],
}
