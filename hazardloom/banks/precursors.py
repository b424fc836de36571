"""Banks of the precursor features v0.2 and of the long evidence spans."""

# Precursor feature groups, prefix -> name -> patterns, in feature order.
FEATURES = {
    "hazard_": {
        "electrical": [r"\belectric", r"\bvoltage\b", r"\benergized\b", r"\bshock\b"],
        "mechanical": [r"\bmachin", r"\bmoving part", r"\brotat", r"\bconveyor\b", r"\broller\b", r"\bpress\b"],
        "pressure": [r"\bpressure\b", r"\bpressur", r"\bstored energy\b", r"\bcompressed\b"],
        "chemical": [
            r"\bchemical\b", r"\bammonia\b", r"\bchlorine\b", r"\bsolvent\b", r"\bacid\b", r"\bcaustic\b",
            r"\btoxic\b", r"\bcorrosive\b",
        ],
        "thermal": [r"\bhot\b", r"\bsteam\b", r"\bheat\b", r"\bthermal\b", r"\bburn\b"],
        "fire_explosion": [r"\bfire\b", r"\bexplos", r"\bflammab", r"\bignition\b"],
        "vehicle": [
            r"\bvehicle\b", r"\btruck\b", r"\bcar\b", r"\bforklift\b", r"\bcrane\b", r"\bexcavat", r"\bloader\b",
            r"\bdriv(?:e|er|ing)\b",
        ],
        "dropped_object": [r"\bdropped object\b", r"\bdropped\b.*\b(?:tool|object|material|load)\b", r"\bfalling object\b"],
        "fall_height": [
            r"\bfall\b", r"\bfell\b", r"\bladder\b", r"\bscaffold", r"\bplatform\b", r"\bheight\b", r"\belevated\b",
        ],
        "caught_between": [r"\bpinch\b", r"\btrapped\b", r"\bcaught\b", r"\bbetween\b", r"\bcrush\b"],
        "sharp_object": [r"\bsharp\b", r"\bblade\b", r"\bknife\b", r"\bcutting\b", r"\bedge\b"],
        "ground_instability": [
            r"\bunstable ground\b", r"\bsoft ground\b", r"\bexcavat", r"\bslope\b", r"\bslip\b", r"\btrip\b",
        ],
    },
    "exposure_": {
        "direct_contact": [r"\bcontact(?:ed|ing)?\b", r"\btouched\b", r"\bhand\b.*\b(?:near|on|against)\b"],
        "line_of_fire": [r"\bline of fire\b", r"\bin the path\b", r"\bstruck by\b", r"\bstruck\b", r"\btrajectory\b"],
        "caught_between": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bbetween\b"],
        "fall": [r"\bfall\b", r"\bfell\b", r"\bdropped from\b"],
        "chemical": [
            r"\bsplash\b", r"\bleak(?:age|ed|ing)?\b", r"\bspill(?:ed|ing)?\b",
            r"\bexpos(?:e|ed|ure)\b.*\b(?:gas|vapou?r|chemical)\b",
        ],
        "thermal": [r"\bhot\b", r"\bsteam\b", r"\bthermal\b", r"\bheat\b"],
        "electrical": [r"\belectric", r"\benergized\b", r"\bvoltage\b"],
        "vehicle": [r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bcrane\b", r"\bdriver\b"],
    },
    "barrier_": {
        "ppe_present": [
            r"\bwear(?:ing)?\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe)\b",
            r"\b(?:gloves?|helmet|goggles?|face shield|ppe)\b.*\bused\b",
        ],
        "ppe_gap": [
            r"\bwithout\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe)\b",
            r"\bno\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe)\b", r"\bdid not\b.*\bwear\b",
        ],
        "guard_gap": [r"\bwithout guard\b", r"\bguard\b.*\b(?:removed|missing|open)\b", r"\bbonnet\b.*\bopen\b"],
        "isolation_gap": [
            r"\bnot isolated\b", r"\bnot lock(?:ed)? out\b", r"\bwithout isolation\b", r"\benergized\b.*\bwork\b",
        ],
        "exclusion_gap": [r"\bno exclusion\b", r"\bnot barricaded\b", r"\bnot blocked\b", r"\bline of fire\b.*\bno\b"],
        "fall_protection_gap": [
            r"\bwithout\b.*\b(?:harness|fall protection|lifeline)\b", r"\bno\b.*\b(?:harness|fall protection|lifeline)\b",
        ],
        "procedure_signal": [r"\bpermit\b", r"\bjsa\b", r"\brisk assessment\b", r"\bprocedure\b", r"\bchecklist\b"],
    },
    "": {
        "human_present": [
            r"\bworker\b", r"\boperator\b", r"\bemployee\b", r"\btechnician\b", r"\bmechanic\b", r"\bdriver\b",
            r"\bperson\b",
        ],
        "unexpected_motion": [
            r"\bunexpected(?:ly)?\b", r"\bstarted to move\b", r"\bstarts to move\b",
            r"\baccidentally\b.*\b(?:activated|started|turned on)\b",
        ],
        "loss_of_control": [r"\blost control\b", r"\bloses control\b", r"\bloss of control\b", r"\bfailed to respond\b"],
        "projectile_release": [
            r"\bproject(?:ed|ile)\b", r"\beject(?:ed|ion)\b", r"\bfragment\b", r"\bsplinter\b", r"\bthrown\b",
        ],
        "containment_release": [
            r"\bleak(?:age|ed|ing)?\b", r"\bspill(?:ed|ing)?\b", r"\bruptur(?:e|ed)\b",
            r"\brelease(?:d)?\b.*\b(?:gas|vapou?r|liquid)\b",
        ],
        "confined_space": [r"\bconfined space\b", r"\btank\b", r"\bvessel\b", r"\binside the chute\b"],
        "traffic_interaction": [
            r"\bpedestrian\b", r"\btraffic\b", r"\bvehicle\b.*\bperson\b", r"\bperson\b.*\bvehicle\b",
        ],
    },
}

# Magnitudes, body parts and interactions.
HEIGHT = r"(?:height(?: of)?|approximately|about)\s*(\d+(?:[.,]\d+)?)\s*(?:m|meter|meters)\b"
VOLTAGE = r"\b(\d+(?:[.,]\d+)?)\s*v(?:olts?)?\b"
BODY_PARTS = ["hand", "finger", "arm", "leg", "foot", "face", "eye", "head", "chest", "back", "neck"]
INTERACTIONS = {
    "ix_electrical_exposure": ("hazard_electrical", "exposure_electrical"),
    "ix_mechanical_direct": ("hazard_mechanical", "exposure_direct_contact"),
    "ix_mechanical_line_fire": ("hazard_mechanical", "exposure_line_of_fire"),
    "ix_vehicle_exposure": ("hazard_vehicle", "exposure_vehicle"),
    "ix_fall_exposure": ("hazard_fall_height", "exposure_fall"),
    "ix_caught_between": ("hazard_caught_between", "exposure_caught_between"),
    "ix_chemical_exposure": ("hazard_chemical", "exposure_chemical"),
    "ix_thermal_exposure": ("hazard_thermal", "exposure_thermal"),
    "ix_vehicle_line_fire": ("hazard_vehicle", "exposure_line_of_fire"),
    "ix_isolation_gap_electrical": ("hazard_electrical", "barrier_isolation_gap"),
    "ix_guard_gap_mechanical": ("hazard_mechanical", "barrier_guard_gap"),
    "ix_fall_gap": ("hazard_fall_height", "barrier_fall_protection_gap"),
    "ix_release_line_fire": ("projectile_release", "exposure_line_of_fire"),
}

# Span families, evidence type -> name -> patterns.
SPANS = {
    "precursor": {
        "Electrical energy": [
            r"\belectric", r"\benergized\b", r"\bvoltage\b", r"\bswitchboard\b", r"\bpanel\b", r"\bcable\b",
        ],
        "Moving equipment / mechanical energy": [
            r"\bmachin", r"\bconveyor\b", r"\broller\b", r"\brotat", r"\bmoving part", r"\bpress\b",
        ],
        "Pressure / stored energy": [r"\bpressur", r"\bcompressed\b", r"\bstored energy\b", r"\bpressure\b"],
        "Chemical / hazardous release": [
            r"\bammonia\b", r"\bchlorine\b", r"\bchemical\b", r"\bsolvent\b", r"\bacid\b", r"\bcaustic\b",
            r"\btoxic\b", r"\bcorrosive\b", r"\bleak(?:age|ed|ing)?\b", r"\bspill(?:ed|ing)?\b", r"\brelease(?:d)?\b",
        ],
        "Thermal energy": [r"\bsteam\b", r"\bhot\b", r"\bheat\b", r"\bthermal\b"],
        "Fire / explosion energy": [r"\bfire\b", r"\bexplos", r"\bflammab", r"\bignition\b"],
        "Vehicle interaction": [r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bcrane\b", r"\bexcavat", r"\bloader\b"],
        "Fall from height": [
            r"\bladder\b", r"\bscaffold", r"\bplatform\b", r"\bheight\b", r"\belevated\b", r"\bfell\b", r"\bfall\b",
        ],
        "Caught-between / pinch mechanism": [r"\bpinch\b", r"\bcaught\b", r"\btrapped\b", r"\bbetween\b"],
        "Dropped / falling object": [r"\bdropped\b", r"\bfalling object\b", r"\btool\b.*\bfall", r"\bmaterial\b.*\bfall"],
        "Line-of-fire exposure": [
            r"\bline of fire\b", r"\bin the path\b", r"\btrajectory\b", r"\bstruck by\b", r"\bstruck\b",
        ],
    },
    "barrier": {
        "PPE gap": [
            r"\bwithout\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe)\b",
            r"\bno\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe)\b", r"\bdid not\b.*\bwear\b",
        ],
        "Guard gap": [
            r"\bwithout guard\b", r"\bguard\b.*\b(?:removed|missing|open)\b", r"\b(?:bonnet|cover)\b.*\bopen\b",
        ],
        "Isolation gap": [
            r"\bnot isolated\b", r"\bnot lock(?:ed)? out\b", r"\bwithout isolation\b", r"\benergized\b.*\bwork\b",
        ],
        "Fall-protection gap": [
            r"\bwithout\b.*\b(?:harness|fall protection|lifeline)\b", r"\bno\b.*\b(?:harness|fall protection|lifeline)\b",
        ],
        "Exclusion / barricade gap": [r"\bnot barricaded\b", r"\bnot blocked\b", r"\bno exclusion\b"],
        "Procedure / permit signal": [r"\bpermit\b", r"\bjsa\b", r"\brisk assessment\b", r"\bprocedure\b", r"\bchecklist\b"],
    },
    "lsr": {
        "Isolation": [r"\benergized\b", r"\bnot isolated\b", r"\bisolat(?:e|ed|ion)\b", r"\block(?:ed)? out\b", r"\blockout\b"],
        "Line of Fire": [
            r"\bline of fire\b", r"\bstruck by\b", r"\btrajectory\b", r"\bin the path\b", r"\bbetween\b", r"\bpinch\b",
        ],
        "Work at Height": [
            r"\bladder\b", r"\bscaffold", r"\bplatform\b", r"\bheight\b", r"\bharness\b", r"\blifeline\b",
        ],
        "Driving": [r"\bdriv(?:e|er|ing)\b", r"\bvehicle\b", r"\btruck\b", r"\bforklift\b", r"\bseat belt\b"],
        "Safe Mechanical Lifting": [r"\bcrane\b", r"\blifting\b", r"\bload\b", r"\bsling\b", r"\blifting tool\b"],
        "Hot Work": [r"\bhot work\b", r"\bwelding\b", r"\bcutting\b", r"\bignition\b", r"\bflammab"],
        "Confined Space": [r"\bconfined space\b", r"\bvessel\b", r"\btank\b", r"\binside\b.*\b(?:tank|vessel)\b"],
        "Chemical Exposure": [
            r"\bammonia\b", r"\bchlorine\b", r"\btoxic\b", r"\bchemical\b", r"\bcorrosive\b", r"\bgas\b.*\bexpos",
        ],
    },
}
