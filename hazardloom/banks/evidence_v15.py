"""Evidence bank v1.5."""

# Patterns per category, tried in this order.
HAZARDS = {
    "electrical": [
        r"\belectric(?:al|ity)?\b", r"\benergized\b", r"\bde[- ]?energized\b", r"\bvoltage\b", r"\bkv\b",
        r"\bpower\b", r"\belectric shock\b",
    ],
    "chemical": [
        r"\bchemical\b", r"\bsolvent\b", r"\bacid\b", r"\bcaustic\b", r"\btoxic\b", r"\bcorrosive\b",
        r"\bthinner\b", r"\bpaint\b", r"\bchlorine\b", r"\bammonia\b", r"\bfume\b", r"\bvapou?r\b", r"\bgas\b",
        r"\bmixture\b",
    ],
    "thermal": [
        r"\bsteam\b", r"\bhot\b", r"\bheat\b", r"\bthermal\b", r"\bburn(?:ed|ing)?\b", r"\bscald(?:ed|ing)?\b",
    ],
    "pressure": [r"\bpressur(?:e|ized|ised)\b", r"\bcompressed\b", r"\bstored energy\b", r"\bhydraulic\b"],
    "fire_explosion": [r"\bfire\b", r"\bexplos(?:ion|ive|ed)\b", r"\bflammab", r"\bignition\b", r"\bcombust"],
    "vehicle": [
        r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bcrane\b", r"\bexcavat(?:or|ing)\b", r"\bloader\b",
        r"\blocomotive\b", r"\bdriver\b", r"\bdriving\b", r"\boccupants?\b", r"\bpedestrian\b",
    ],
    "fall_height": [
        r"\bheight\b", r"\belevated\b", r"\bscaffold", r"\bladder\b", r"\bplatform\b", r"\btower\b", r"\bfell\b",
        r"\bfall(?:ing)?\b",
    ],
    "mechanical": [
        r"\bmachin", r"\bconveyor\b", r"\broller\b", r"\brotat", r"\bmoving part\b", r"\bpress\b", r"\bmixer\b",
    ],
    "stored_projectile": [
        r"\bproject(?:ile|ed)\b", r"\beject(?:ed|ion)\b", r"\bthrown\b", r"\bdropped\b", r"\bfalling object\b",
        r"\bsplash(?:ed)?\b", r"\bflow\b",
    ],
}

EXPOSURES = {
    "chemical_exposure": [
        r"\binhal",
        r"\bfume",
        r"\bvapou?r",
        r"\bchemical exposure\b",
        r"\bchemical\b.{0,100}\b(?:skin|eye|face|mouth|lip|shoulder|body)\b",
        r"\b(?:skin|eye|face|mouth|lip|shoulder|body)\b.{0,100}\b(?:chemical|solvent|acid|thinner|paint)\b",
        r"\b(?:splash|projected)\b.{0,80}\b(?:chemical|thinner|solvent|acid|paint)\b",
        r"\b(?:chemical|thinner|solvent|acid|paint)\b.{0,80}\b(?:splash|projected)\b",
    ],
    "thermal_exposure": [
        r"\bburn(?:ed|ing)?\b",
        r"\bscald(?:ed|ing)?\b",
        r"\bhot\b.{0,100}\b(?:contact|skin|body|burn)\b",
        r"\bsteam\b.{0,100}\b(?:contact|skin|body|burn)\b",
        r"\bredness\b.{0,80}\bburning\b",
    ],
    "electrical_exposure": [
        r"\belectric shock\b",
        r"\b(?:received|suffered|got)\b.{0,60}\belectric(?:al)?\b",
        r"\benergized\b.{0,80}\b(?:contact|touched|shock)\b",
        r"\bcontact\b.{0,80}\benergized\b",
    ],
    "vehicle_exposure": [
        r"\bvehicle exposure\b",
        r"\bpedestrian\b",
        r"\b(?:hit|struck|collision|collid|ran over|run over)\b.{0,100}\b(?:vehicle|truck|forklift|crane|loader|excavator)\b",
        r"\b(?:vehicle|truck|forklift|crane|loader|excavator)\b.{0,100}\b(?:hit|struck|collision|collid|ran over|run over)\b",
        r"\b(?:vehicle|truck|forklift|crane|loader|excavator)\b.{0,80}\bperson(?:nel)?\b",
    ],
    "fall_exposure": [
        r"\bfell\b",
        r"\bfall(?:ing)?\b.{0,80}\b(?:from|off)\b",
        r"\b(?:from|off)\b.{0,80}\b(?:height|platform|scaffold|tower|ladder)\b",
    ],
    "line_of_fire": [
        r"\bline of fire\b",
        r"\bstruck by\b",
        r"\bin the path\b",
        r"\btrajectory\b",
        r"\bpath of\b.{0,70}\b(?:flow|object|vehicle|material)\b",
    ],
    "caught_between_exposure": [
        r"\bpinch\b",
        r"\bcaught\b.{0,70}\b(?:between|in|inside)\b",
        r"\btrapped\b.{0,70}\b(?:between|in|inside)\b",
        r"\bcrush(?:ed|ing)?\b",
    ],
    "direct_contact": [r"\bcontact(?:ed)?\b", r"\btouched\b", r"\bprojected onto\b", r"\bsplashed\b"],
}

NOT_AN_EXPOSURE = "direct_contact"

# Pathway -> (its patterns, or the exposure whose evidence it shares; hazards one of which must be present).
PATHWAYS = {
    "electrical_contact": ("electrical_exposure", ["electrical"]),
    "chemical_release_exposure": ("chemical_exposure", ["chemical"]),
    "thermal_contact": ("thermal_exposure", ["thermal"]),
    "fall_from_height": ("fall_exposure", ["fall_height"]),
    "struck_by_projectile": (
        [
            r"\bstruck by\b",
            r"\bproject(?:ile|ed)\b.{0,100}\b(?:hit|strike|person|worker)\b",
            r"\beject(?:ed|ion)\b.{0,100}\b(?:hit|strike|person|worker)\b",
            r"\bfalling object\b.{0,100}\b(?:hit|strike|person|worker)\b",
        ],
        ["stored_projectile", "mechanical", "pressure"],
    ),
    "caught_crush": ("caught_between_exposure", ["mechanical"]),
    "vehicle_person_collision": ("vehicle_exposure", ["vehicle"]),
}

MINOR_CONTEXT = {
    "localized_reaction": [r"\blocalized\b", r"\blocalised\b", r"\bmild\b", r"\bminor\b", r"\bslight\b"],
    "redness_swelling": [r"\bredness\b", r"\bswelling\b", r"\birritation\b"],
    "superficial_injury": [
        r"\bsuperficial\b", r"\bsmall cut\b", r"\bminor cut\b", r"\bminor laceration\b", r"\bscratch\b",
    ],
    "no_time_loss": [
        r"\bcould continue the activity\b", r"\bcontinued the activity\b", r"\breturned to work\b",
        r"\bno lost time\b", r"\bwithout lost time\b",
    ],
}

SEVERE_CONTEXT = {
    "fatality": [r"\bfatal(?:ity)?\b", r"\bdied\b", r"\bdeath\b", r"\bkilled\b"],
    "loss_of_consciousness": [r"\b(unconscious|loss of consciousness)\b"],
    "hospitalization": [r"\bhospital(?:ized|ised|ization|isation)\b", r"\badmitted to hospital\b"],
    "fracture_amputation": [r"\bfracture\b", r"\bamputation\b", r"\bamputated\b"],
    "severe_burn": [
        r"\bsevere burn\b", r"\bsecond degree burn\b", r"\bthird degree burn\b", r"\bextensive burn\b",
    ],
}

CONTEXT = {
    "water_mud": [r"\bwater\b", r"\bmud\b"],
    "no_person_affected": [
        r"\bno presence of personnel\b",
        r"\bno personnel\b.{0,80}\b(?:affected|injur)\b",
        r"\bno one\b.{0,80}\b(?:affected|injur)\b",
    ],
    "deenergized_disabled": [r"\bde[- ]?energized\b", r"\bdisabled\b"],
    "protective_equipment": [
        r"\b(?:ppe|ep[pi]s?)\b", r"\bsafety belt\b", r"\bseat belt\b", r"\bsafety harness\b",
    ],
    "distance_context": [r"\b\d+\s*(?:m|meter|meters|metres)\b", r"\bdistance\b"],
    "containment": [r"\bcontained\b", r"\bcontainment\b", r"\bclosed system\b", r"\binside the container\b"],
}
