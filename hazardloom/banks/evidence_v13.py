"""Evidence bank v1.3: stricter pathways with open gaps."""

# Patterns per category, tried in this order.
HAZARDS = {
    "electrical": [
        r"\belectric(?:al|ity)?\b", r"\benergized\b", r"\bde-energized\b", r"\bvoltage\b", r"\bkv\b", r"\bpower\b",
        r"\bshort circuit\b", r"\belectric shock\b",
    ],
    "chemical": [
        r"\bchemical\b", r"\bsolvent\b", r"\bacid\b", r"\bcaustic\b", r"\btoxic\b", r"\bcorrosive\b",
        r"\bthinner\b", r"\bpaint\b", r"\bchlorine\b", r"\bammonia\b", r"\bgas\b", r"\bfume\b", r"\bvapou?r\b",
    ],
    "thermal": [r"\bsteam\b", r"\bhot\b", r"\bheat\b", r"\bthermal\b", r"\bburn(?:ed|ing)?\b", r"\bscald"],
    "pressure": [r"\bpressur(?:e|ized|ised)\b", r"\bcompressed\b", r"\bstored energy\b", r"\bpressure vessel\b"],
    "fire_explosion": [r"\bfire\b", r"\bexplos(?:ion|ive|ed)\b", r"\bflammab", r"\bignition\b", r"\bcombust"],
    "vehicle": [
        r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bcrane\b", r"\bexcavat(?:or|ing)\b", r"\bloader\b",
        r"\blocomotive\b", r"\bdriver\b", r"\bdriving\b",
    ],
    "fall_height": [
        r"\bheight\b", r"\belevated\b", r"\bscaffold", r"\bladder\b", r"\bplatform\b", r"\btower\b", r"\bfell\b",
        r"\bfall(?:ing)?\b", r"\bdropped from\b",
    ],
    "mechanical": [
        r"\bmachin", r"\bconveyor\b", r"\broller\b", r"\brotat", r"\bmoving part\b", r"\bpress\b", r"\bmixer\b",
    ],
    "stored_projectile": [
        r"\bproject(?:ile|ed)\b", r"\beject(?:ed|ion)\b", r"\bthrown\b", r"\bdropped\b", r"\bfalling object\b",
    ],
}

EXPOSURES = {
    "chemical_exposure": [
        r"\binhal", r"\bfume", r"\bvapou?r", r"\bchemical exposure\b",
        r"\bsplash(?:ed)? .*?(?:skin|eye|face|shoulder|lip|body)\b",
        r"\bcontact(?:ed)? .*?(?:chemical|solvent|acid|thinner|paint)\b",
    ],
    "thermal_exposure": [
        r"\bburn", r"\bscald", r"\bhot\b.*\b(?:contact|skin|body)\b", r"\bsteam\b.*\b(?:contact|injur|burn)\b",
        r"\b(?:water|liquid)\b.*\bhot\b",
    ],
    "electrical_exposure": [
        r"\belectric shock\b", r"\b(?:received|suffered|got)\b.*\belectric\b",
        r"\benergized\b.*\b(?:contact|touched|shock)\b", r"\bcontact\b.*\benergized\b",
    ],
    "vehicle_exposure": [
        r"\bvehicle\b.*\b(?:hit|struck|collision|collid|ran over|run over)\b",
        r"\b(?:hit|struck|collision|collid)\b.*\bvehicle\b", r"\bvehicle exposure\b", r"\bpedestrian\b",
    ],
    "fall_exposure": [
        r"\bfell\b", r"\bfall(?:ing)?\b.*\b(?:from|off)\b",
        r"\b(?:from|off)\b.*\b(?:height|platform|scaffold|tower|ladder)\b",
    ],
    "line_of_fire": [r"\bline of fire\b", r"\bstruck by\b", r"\bin the path\b", r"\btrajectory\b"],
    "caught_between_exposure": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bcrush"],
    "generic_human_present": [
        r"\boperator\b", r"\bemployee\b", r"\bcollaborator\b", r"\bworker\b", r"\btechnician\b", r"\bsupervisor\b",
        r"\bforeman\b", r"\boccupant(?:s)?\b", r"\bperson(?:nel)?\b",
    ],
}

NOT_AN_EXPOSURE = "generic_human_present"

# Pathway -> (patterns, hazards one of which must be present).
PATHWAYS = {
    "electrical_contact": (
        [
            r"\belectric shock\b", r"\benergized\b.*\b(?:contact|touch)\b", r"\bcontact\b.*\benergized\b",
            r"\bvoltage\b.*\bcontact\b",
        ],
        ["electrical"],
    ),
    "chemical_release_exposure": (
        [
            r"\b(?:chemical|solvent|acid|caustic|thinner|paint|toxic|corrosive)\b.{0,100}\b(?:spill|leak|release|splash|inhal|fume|vapou?r)\b",
            r"\b(?:spill|leak|release|splash|inhal|fume|vapou?r)\b.{0,100}\b(?:chemical|solvent|acid|caustic|thinner|paint|toxic|corrosive)\b",
            r"\bchemical exposure\b",
            r"\binhal(?:ed|ation)?\b",
        ],
        ["chemical"],
    ),
    "thermal_contact": (
        [
            r"\bsteam\b.*\b(?:contact|burn|scald|injur)\b", r"\bhot\b.*\b(?:contact|burn|scald|injur)\b",
            r"\b(?:burn|scald)\w*\b.*\b(?:hot|steam|heat|thermal)\b",
        ],
        ["thermal"],
    ),
    "fall_from_height": (
        [
            r"\bfell\b.*\b(?:height|platform|scaffold|tower|ladder)\b",
            r"\bfall(?:ing)?\b.*\b(?:height|platform|scaffold|tower|ladder)\b",
            r"\b(?:height|platform|scaffold|tower|ladder)\b.*\bfall\b",
        ],
        ["fall_height"],
    ),
    "struck_by_projectile": (
        [
            r"\bstruck by\b", r"\bstruck\b.*\b(?:object|material|projectile)\b",
            r"\bproject(?:ile|ed)\b.*\b(?:hit|strike|person|worker)\b",
            r"\beject(?:ed|ion)\b.*\b(?:hit|strike|person|worker)\b",
        ],
        ["stored_projectile", "mechanical", "pressure"],
    ),
    "caught_crush": (
        [
            r"\bpinch\b.*\b(?:hand|finger|person|worker)\b", r"\bcaught\b.*\b(?:between|in|inside)\b",
            r"\btrapped\b.*\b(?:between|in|inside)\b", r"\bcrush(?:ed|ing)?\b",
        ],
        ["mechanical"],
    ),
    "vehicle_person_collision": (
        [
            r"\b(?:vehicle|truck|forklift|crane|loader|excavator)\b.{0,100}\b(?:hit|struck|collision|collid|run over|ran over)\b",
            r"\b(?:hit|struck|collision|collid|run over|ran over)\b.{0,100}\b(?:vehicle|truck|forklift|crane|loader|excavator)\b",
            r"\bvehicle\b.*\bpedestrian\b",
        ],
        ["vehicle"],
    ),
}

CONTEXT = {
    "water_mud_only": [r"\bwater\b.*\bmud\b", r"\bmud\b.*\bwater\b"],
    "no_person_affected": [
        r"\bno presence of personnel\b", r"\bno personnel\b.*\b(?:affected|injur)\b",
        r"\bno one\b.*\b(?:affected|injur)\b",
    ],
    "deenergized_disabled": [r"\bde-energized\b", r"\bdeenergized\b", r"\bdisabled\b"],
}
