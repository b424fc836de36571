"""Banks of the control/gap mention audit and of the pathway inspection."""

from hazardloom.banks import pathway_features as pf

# Mentions of controls and of gaps, per sentence.
CONTROLS = {
    "PPE": [
        r"\bgloves?\b", r"\bhelmet\b", r"\bsafety shoes?\b", r"\bgoggles?\b", r"\bface shield\b", r"\brespirator\b",
        r"\bppe\b",
    ],
    "Guarding": [
        r"\bguard\b", r"\bguarding\b", r"\bcover\b", r"\bbarrier\b", r"\bbarricad", r"\bfence\b", r"\bhandrail\b",
    ],
    "Isolation": [
        r"\bisolat(?:e|ed|ion)\b", r"\blockout\b", r"\block out\b", r"\bloto\b", r"\bde-energ", r"\bdeenerg",
    ],
    "Fall protection": [r"\bharness\b", r"\blifeline\b", r"\bfall protection\b", r"\bscaffold\b", r"\bguardrail\b"],
    "Permit / procedure": [
        r"\bpermit\b", r"\bjsa\b", r"\bjob safety analysis\b", r"\brisk assessment\b", r"\bprocedure\b", r"\bchecklist\b",
    ],
    "Exclusion / distance": [
        r"\bsafe distance\b", r"\bexclusion zone\b", r"\brestricted area\b", r"\bstand clear\b", r"\bkeep clear\b",
        r"\baway from\b",
    ],
    "Lifting controls": [
        r"\bsling\b", r"\bshackle\b", r"\btag line\b", r"\btagline\b", r"\bcertified\b.*\blift", r"\b lifting plan\b",
    ],
}

GAPS = {
    "missing_control": [
        r"\bwithout\b.*\b(?:gloves?|helmet|goggles?|face shield|ppe|guard|harness|lifeline)\b",
        r"\bno\b.*\b(?:guard|harness|lifeline|barricad|isolation|permit|ppe)\b",
        r"\bnot\b.*\b(?:isolated|barricaded|guarded|protected)\b",
        r"\bfailed to\b.*\b(?:isolate|lockout|barricad|wear|use)\b",
        r"\bdid not\b.*\b(?:wear|isolate|lock|secure|barricad|follow)\b",
    ],
    "control_present": [
        r"\bwear(?:ing)?\b", r"\bused\b", r"\bprovided\b", r"\binstalled\b", r"\bsecured\b", r"\bisolated\b",
        r"\bguarded\b", r"\bbarricaded\b", r"\bprotected\b", r"\bfollowed\b",
    ],
}

# Pathway inspection; several of its lists equal those of the feature bank.
HAZARDS = {
    "electrical_energy": [
        r"\belectric", r"\benergized\b", r"\bvoltage\b", r"\bpanel\b", r"\bswitchboard\b", r"\bcable\b",
    ],
    "mechanical_energy": pf.HAZARDS["mechanical"],
    "pressure_stored_energy": [r"\bpressur", r"\bcompressed\b", r"\bstored energy\b"],
    "chemical_release": pf.HAZARDS["chemical"],
    "thermal_energy": pf.HAZARDS["thermal"],
    "fire_explosion_energy": pf.HAZARDS["fire_explosion"],
    "vehicle_energy": pf.HAZARDS["vehicle"],
    "height_fall_energy": pf.HAZARDS["fall_height"],
    "caught_between_mechanism": pf.HAZARDS["caught_between"],
    "dropped_object": pf.HAZARDS["dropped_object"],
}
EXPOSURES = {
    "human_present": [
        r"\bworker\b", r"\boperator\b", r"\bemployee\b", r"\btechnician\b", r"\bmechanic\b", r"\bdriver\b", r"\bperson\b",
    ],
    "direct_contact": pf.EXPOSURES["direct_contact"],
    "line_of_fire": pf.EXPOSURES["line_of_fire"],
    "caught_between": pf.EXPOSURES["caught_between"],
    "fall_exposure": pf.EXPOSURES["fall"],
    "chemical_exposure": [
        r"\bsplash\b", r"\bexpos(?:e|ed|ure)\b", r"\binhal", r"\breath", r"\bfume", r"\bgas\b", r"\bvapou?r\b",
        r"\bleak", r"\bspill",
    ],
    "thermal_exposure": pf.EXPOSURES["thermal"],
    "vehicle_exposure": pf.EXPOSURES["vehicle"],
}
PATHWAYS = {
    "struck_by_or_projectile": pf.PATHWAYS["struck_by_projectile"],
    "caught_crush": [*pf.PATHWAYS["caught_crush"], r"\bamputation\b"],
    "fall_from_height": pf.PATHWAYS["fall_from_height"],
    "electrical_contact": pf.PATHWAYS["electrical_contact"],
    "chemical_release_exposure": pf.PATHWAYS["chemical_release_exposure"],
    "thermal_contact": pf.PATHWAYS["thermal_contact"],
    "vehicle_person_collision": pf.PATHWAYS["vehicle_person_collision"],
}
INSPECTION_CONTROLS = {
    "ppe": [r"\bgloves?\b", r"\bhelmet\b", r"\bgoggles?\b", r"\bface shield\b", r"\bppe\b"],
    "guarding": [r"\bguard\b", r"\bcover\b", r"\bbarricad", r"\bbarrier\b"],
    "isolation": [r"\bisolat", r"\blockout\b", r"\block out\b", r"\bloto\b", r"\bde-energ"],
    "fall_protection": [r"\bharness\b", r"\blifeline\b", r"\bfall protection\b", r"\bguardrail\b"],
    "permit_procedure": [r"\bpermit\b", r"\bjsa\b", r"\bjob safety\b", r"\brisk assessment\b", r"\bprocedure\b"],
    "distance_exclusion": [r"\bsafe distance\b", r"\bexclusion zone\b", r"\bkeep clear\b", r"\bstand clear\b"],
}
NEGATIONS = [r"\bwithout\b", r"\bno\b", r"\bnot\b", r"\bdid not\b", r"\bfailed to\b", r"\bmissing\b", r"\bremoved\b", r"\bopen\b"]
