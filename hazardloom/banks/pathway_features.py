"""Bank of the 38 pathway features beside the model; deliberately not the evidence bank."""

# Patterns per category, in feature order.
HAZARDS = {
    "electrical": [r"\belectric", r"\benergized\b", r"\bvoltage\b", r"\bpanel\b", r"\bcable\b"],
    "mechanical": [r"\bmachin", r"\bconveyor\b", r"\broller\b", r"\brotat", r"\bmoving part", r"\bpress\b"],
    "pressure": [r"\bpressur", r"\bcompressed\b", r"\bstored energy\b", r"\bpressure\b"],
    "chemical": [
        r"\bammonia\b", r"\bchlorine\b", r"\bchemical\b", r"\bsolvent\b", r"\bacid\b", r"\bcaustic\b",
        r"\btoxic\b", r"\bcorrosive\b", r"\bleak", r"\bspill", r"\brelease\b",
    ],
    "thermal": [r"\bsteam\b", r"\bhot\b", r"\bheat\b", r"\bthermal\b"],
    "fire_explosion": [r"\bfire\b", r"\bexplos", r"\bflammab", r"\bignition\b"],
    "vehicle": [
        r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bcrane\b", r"\bexcavat", r"\bloader\b",
        r"\bdriv(?:e|er|ing)\b",
    ],
    "fall_height": [
        r"\bladder\b", r"\bscaffold", r"\bplatform\b", r"\bheight\b", r"\belevated\b", r"\bfell\b", r"\bfall\b",
    ],
    "caught_between": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bbetween\b"],
    "dropped_object": [r"\bdropped\b", r"\bfalling object\b", r"\btool\b.*\bfall", r"\bmaterial\b.*\bfall"],
}

EXPOSURES = {
    "direct_contact": [r"\bcontact(?:ed|ing)?\b", r"\btouched\b", r"\bhand\b.*\b(?:near|on|against)\b"],
    "line_of_fire": [r"\bline of fire\b", r"\bin the path\b", r"\btrajectory\b", r"\bstruck by\b", r"\bstruck\b"],
    "caught_between": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bbetween\b"],
    "fall": [r"\bfell\b", r"\bfall\b", r"\bdropped from\b"],
    "chemical": [
        r"\bsplash\b", r"\bleak", r"\bspill", r"\bexpos(?:e|ed|ure)\b", r"\binhal", r"\bfume", r"\bgas\b",
        r"\bvapou?r\b",
    ],
    "thermal": [r"\bhot\b", r"\bsteam\b", r"\bheat\b", r"\bburn"],
    "electrical": [r"\belectric", r"\benergized\b", r"\bvoltage\b", r"\bshock\b"],
    "vehicle": [r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bdriver\b", r"\bpedestrian\b"],
}

PATHWAYS = {
    "struck_by_projectile": [
        r"\bstruck by\b", r"\bstruck\b", r"\bproject(?:ed|ile)\b", r"\beject(?:ed|ion)\b", r"\bthrown\b",
    ],
    "caught_crush": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bcrush"],
    "fall_from_height": [
        r"\bladder\b", r"\bscaffold", r"\bplatform\b", r"\bheight\b", r"\belevated\b", r"\bfell\b",
    ],
    "electrical_contact": [r"\belectric", r"\benergized\b", r"\bvoltage\b", r"\bshock\b", r"\bcontact\b"],
    "chemical_release_exposure": [
        r"\bleak", r"\bspill", r"\brelease", r"\bsplash", r"\binhal", r"\bfume", r"\bgas\b", r"\bvapou?r\b",
    ],
    "thermal_contact": [r"\bhot\b", r"\bsteam\b", r"\bheat\b", r"\bthermal\b"],
    "vehicle_person_collision": [
        r"\bvehicle\b.*\bperson\b", r"\bperson\b.*\bvehicle\b", r"\bpedestrian\b", r"\bstruck\b.*\bvehicle\b",
    ],
}

# Feature -> (hazard, exposure, pathway) that must all be present.
COMPLETE = {
    "path_electrical_complete": ("electrical", "electrical", "electrical_contact"),
    "path_chemical_complete": ("chemical", "chemical", "chemical_release_exposure"),
    "path_fall_complete": ("fall_height", "fall", "fall_from_height"),
    "path_vehicle_complete": ("vehicle", "vehicle", "vehicle_person_collision"),
    "path_caught_complete": ("caught_between", "caught_between", "caught_crush"),
}
