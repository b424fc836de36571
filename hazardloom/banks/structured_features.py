"""Structured features v0.1 over the v0.6 extraction and the narrative."""

# Feature -> label.
HAZARDS = {
    "electrical": "Electrical energy", "mechanical": "Mechanical / moving equipment energy", "pressure": "Pressure / stored energy",
    "chemical": "Chemical energy / hazardous substance", "thermal": "Thermal energy", "fire_explosion": "Fire / explosion energy",
    "vehicle": "Vehicle / mobile equipment energy", "dropped_object": "Falling object / dropped object energy",
    "fall_height": "Fall-from-height energy", "caught_between": "Caught-between / pinch energy", "sharp_object": "Sharp-object energy",
    "biological": "Biological / animal hazard", "ground": "Ground / unstable terrain", "slip_trip": "Slip / trip surface hazard",
}
EXPOSURES = {
    "direct_contact": "Direct physical contact", "line_of_fire": "Line-of-fire exposure", "caught_between": "Caught-between / pinch exposure",
    "fall": "Fall exposure", "chemical": "Chemical exposure", "thermal": "Thermal exposure", "electrical": "Electrical exposure",
    "vehicle": "Vehicle exposure",
}
ACTUAL = {
    "fatality": "Fatality", "electrical_injury": "Electrical injury", "crush_amputation": "Crushing / amputation",
    "burn_thermal": "Burn / thermal injury", "chemical_injury": "Chemical injury", "cut_laceration": "Cut / laceration",
    "impact": "Struck-by / impact injury", "fall_injury": "Fall injury", "facial_injury": "Eye / facial injury",
    "musculoskeletal": "Musculoskeletal injury", "minor_irritation": "Minor irritation / swelling",
}
POTENTIAL = {
    "severe_electrical": "Potential severe electrical injury", "severe_caught_between": "Potential severe caught-between injury",
    "severe_fall": "Potential severe fall injury", "severe_vehicle": "Potential severe vehicle injury",
    "severe_chemical": "Potential severe chemical injury", "severe_thermal": "Potential severe thermal injury",
    "severe_projectile": "Potential severe projectile injury", "severe_entanglement": "Potential severe entanglement / machine injury",
}
BARRIERS = {
    "ppe": "PPE", "guard": "Guard / physical protection", "isolation": "Isolation / LOTO", "deenergization": "De-energization",
    "fall_protection": "Fall protection", "exclusion": "Exclusion / traffic control", "procedure": "Procedure / JSA / risk assessment",
    "emergency_detection": "Emergency / detection control",
}

# Context cues by pattern and by plain term.
CUES = {
    "human_actor_present": [
        r"\bworker\b", r"\boperator\b", r"\bemployee\b", r"\bmechanic\b", r"\btechnician\b", r"\bcollaborator\b", r"\bdriver\b", r"\bperson\b",
    ],
    "fatality_language": [r"\bfatal\b", r"\bfatality\b", r"\bdied\b", r"\bdeath\b", r"\bkilled\b"],
    "hospital_or_medical_escalation": [
        r"\bhospital\b", r"\bmedical center\b", r"\bmedical post\b", r"\btransferred to\b", r"\bemergency response\b",
    ],
    "loss_of_control": [
        r"\bloses? control\b", r"\bloss of control\b", r"\bcontrol.*(?:failed|did not respond)\b", r"\bstarts to reverse\b",
        r"\bunexpectedly activated\b",
    ],
    "unexpected_activation": [
        r"\baccidentally activates?\b", r"\bunexpectedly\b.*\bactivated\b", r"\bstarts to move\b", r"\bturned on\b", r"\bmotor.*running\b",
        r"\bequipment.*operating\b",
    ],
    "projectile_release": [
        r"\bproject(?:ed|ion)\b", r"\bexpell(?:ed|ing)?\b", r"\breleased\b.*\b(?:fragment|metal|rock|liquid|gas)\b", r"\bsplinter\b",
        r"\bfragment.*impact",
    ],
    "containment_release": [
        r"\bleak\b", r"\bleakage\b", r"\bspill(?:ed)?\b", r"\bruptur(?:e|ed)\b", r"\bprojection of\b", r"\bhot pulp\b",
    ],
    "restricted_area_signal": [
        r"\binside the chute\b", r"\bconfined space\b", r"\brestricted area\b", r"\bfenced area\b", r"\belectrical compartment\b",
    ],
    "ppe_absence_signal": [
        r"\bwithout\b.*\b(?:gloves?|helmet|goggles?|ppe|epps)\b", r"\bno\b.*\b(?:gloves?|helmet|goggles?|ppe|epps)\b",
        r"\bdid not\b.*\b(?:use|wear)\b.*\b(?:gloves?|helmet|ppe|epps)\b",
    ],
    "isolation_gap_signal": [r"\bnot isolated\b", r"\bnot lock(?:ed)? out\b", r"\bwithout isolation\b", r"\benergized\b.*\bwork\b"],
    "guard_gap_signal": [r"\bbonnet open\b", r"\bwithout guard\b", r"\bguard.*(?:removed|missing)\b"],
    "exclusion_gap_signal": [r"\bline of fire\b", r"\bno exclusion\b", r"\bnot blocked\b", r"\bnot barricaded\b"],
}
TERMS = {
    "vehicle_collision_signal": ["crash", "collision", "hits the", "impact", "turns to its side"],
    "vehicle_rollover_signal": ["rollover", "roll over", "turns to its side", "overturn"],
    "vehicle_ejection_signal": ["ejection", "ejected", "thrown from", "jumped out of the cabin"],
    "vehicle_occupant_signal": ["occupant", "occupants", "driver", "operator", "co-pilot", "copilot", "passenger"],
    "seat_belt_signal": ["seat belt", "safety belt"],
}
FIRE_LINE = [r"\bmeters?\b.*\bline of fire\b", r"\bline of fire\b.*\bmeters?\b"]
HEIGHTS = [
    r"(\d+(?:[.,]\d+)?)\s*(?:m|meter|meters)\b.*?(?:height|above|fall|ladder|platform|elevated)",
    r"(?:height|height of|at an approximate height of)\s*(?:approximately\s*)?(\d+(?:[.,]\d+)?)\s*(?:m|meter|meters)\b",
]
VOLTS = r"\b(\d+(?:[.,]\d+)?)\s*v(?:olts?)?\b"
AMPS = r"\b(\d+(?:[.,]\d+)?)\s*a(?:mps?)?\b"

# Interaction -> (hazard label, exposure labels any of which) or (hazard or exposure label, potential label).
WITH_EXPOSURE = {
    "ix_electrical_exposure": ("Electrical energy", ["Electrical exposure", "Direct physical contact"]),
    "ix_mechanical_direct": ("Mechanical / moving equipment energy", ["Direct physical contact", "Caught-between / pinch exposure"]),
    "ix_mechanical_linefire": ("Mechanical / moving equipment energy", ["Line-of-fire exposure"]),
    "ix_vehicle_exposure": ("Vehicle / mobile equipment energy", ["Vehicle exposure"]),
    "ix_vehicle_linefire": ("Vehicle / mobile equipment energy", ["Line-of-fire exposure"]),
    "ix_fall_exposure": ("Fall-from-height energy", ["Fall exposure"]),
    "ix_caught_between": ("Caught-between / pinch energy", ["Caught-between / pinch exposure"]),
    "ix_projectile_linefire": ("Falling object / dropped object energy", ["Line-of-fire exposure"]),
    "ix_thermal_exposure": ("Thermal energy", ["Thermal exposure"]),
    "ix_chemical_exposure": ("Chemical energy / hazardous substance", ["Chemical exposure"]),
}
WITH_POTENTIAL = {
    "ix_severe_electrical": ("Electrical energy", "Potential severe electrical injury"),
    "ix_severe_vehicle": ("Vehicle / mobile equipment energy", "Potential severe vehicle injury"),
    "ix_severe_fall": ("Fall-from-height energy", "Potential severe fall injury"),
    "ix_severe_caught_between": ("Caught-between / pinch energy", "Potential severe caught-between injury"),
    "ix_severe_chemical": ("Chemical energy / hazardous substance", "Potential severe chemical injury"),
    "ix_severe_thermal": ("Thermal energy", "Potential severe thermal injury"),
    "ix_severe_projectile": ("Line-of-fire exposure", "Potential severe projectile injury"),
}
WITH_GAP = {
    "ix_electrical_isolation_gap": ("Electrical energy", ["Isolation / LOTO [failed_or_absent]", "De-energization [failed_or_absent]"]),
    "ix_mechanical_guard_gap": ("Mechanical / moving equipment energy", ["Guard / physical protection [failed_or_absent]"]),
}
