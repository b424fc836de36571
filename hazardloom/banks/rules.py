"""Rule-candidate tables: terms, evidence cues and label weights."""

# Current rules. cues are names looked for in the rendered hazard, exposure
# and pathway lists; words are looked for in the text; either adds the same bonus.
CURRENT = {
    "Bypassing Safety Controls": {
        "terms": ["bypass", "override", "disable", "safety control", "barrier"],
        "words": ["bypass", "override", "disable", "barrier"],
    },
    "Confined Space": {
        "terms": ["confined space", "tank", "vessel"],
        "words": ["confined space", "tank", "vessel"],
    },
    "Driving": {
        "terms": ["vehicle", "truck", "driver", "driving", "collision", "forklift", "excavator", "loader"],
        "hazards": ["vehicle"], "exposures": ["vehicle_exposure"], "pathways": ["vehicle_person_collision"],
    },
    "Energy Isolation": {
        "terms": [
            "energized", "electric", "voltage", "isolation", "lockout", "tagout", "de-energized", "stored energy",
        ],
        "hazards": ["electrical"], "exposures": ["electrical_exposure"], "pathways": ["electrical_contact"],
    },
    "Hot Work": {
        "terms": ["welding", "cutting", "grinding", "hot work", "ignition", "oxyfuel"],
        "hazards": ["fire_explosion"], "words": ["hot work", "oxyfuel"],
    },
    "Line of Fire": {
        "terms": ["line of fire", "struck", "projectile", "dropped object", "moving object", "pressure release"],
        "exposures": ["line_of_fire"], "pathways": ["struck_by_projectile", "vehicle_person_collision"],
    },
    "Safe Mechanical Lifting": {
        "terms": ["lifting", "lifted", "suspended load", "crane", "rigging"],
        "words": ["lifting", "crane", "suspended load"],
    },
    "Work Authorisation": {
        "terms": ["permit", "authorization", "authorisation"],
        "words": ["permit", "authorization", "authorisation"],
    },
    "Working at Height": {
        "terms": ["height", "fall", "scaffold", "ladder", "tower", "platform"],
        "hazards": ["fall_height"], "exposures": ["fall_exposure"], "pathways": ["fall_from_height"],
    },
}

# The wider variant changes the terms of five rules.
EXACT = {name: dict(rule) for name, rule in CURRENT.items()}
EXACT["Confined Space"]["terms"] = ["confined space", "tank", "vessel", "inside tank", "inside vessel"]
EXACT["Driving"]["terms"] = ["vehicle", "truck", "driver", "driving", "collision", "run over"]
EXACT["Hot Work"]["terms"] = ["welding", "cutting", "grinding", "hot work", "ignition", "flammable", "oxyfuel"]
EXACT["Line of Fire"]["terms"] = [
    "line of fire", "struck", "projectile", "dropped object", "moving object", "pressure release", "vehicle", "flow",
]
EXACT["Working at Height"]["terms"] = ["height", "fall", "scaffold", "ladder", "tower", "platform", "elevated"]

# Label-based rules v0.1.
LABELS_V01 = {
    "Work at Height": {
        "hazards": ["Fall-from-height energy"], "exposures": ["Fall exposure"], "activities": ["Working at height"],
        "keywords": ["ladder", "scaffold", "height", "reel", "chimney"],
    },
    "Isolation": {
        "hazards": ["Electrical energy", "Mechanical / moving equipment energy", "Pressure / stored energy"],
        "keywords": [
            "energized", "live", "lockout", "loto", "isolation", "de-energized", "bonnet open", "operating",
        ],
    },
    "Line of Fire": {
        "exposures": [
            "Line-of-fire exposure", "Direct physical contact", "Vehicle exposure", "Thermal exposure",
            "Chemical exposure",
        ],
        "hazards": [
            "Falling object / dropped object energy", "Vehicle / mobile equipment energy",
            "Pressure / stored energy", "Thermal energy", "Fire / explosion energy",
        ],
        "keywords": ["projection", "projected", "line of fire", "impact", "released", "struck", "splash"],
    },
    "Seat Belt": {
        "hazards": ["Vehicle / mobile equipment energy"], "keywords": ["seat belt", "safety belt", "belt"],
    },
    "Driving": {
        "hazards": ["Vehicle / mobile equipment energy"], "activities": ["Driving / vehicle movement"],
        "keywords": ["driving", "reversing", "reversed", "backing", "vehicle movement", "distracted"],
    },
    "Safe Mechanical Lifting": {
        "hazards": ["Falling object / dropped object energy"], "activities": ["Lifting / handling"],
        "keywords": ["lifting", "lifted", "rigging", "suspended", "load"],
    },
    "Confined Space": {"keywords": ["confined space", "discharge chute", "inside the chute", "restricted space"]},
    "Hot Work": {
        "hazards": ["Fire / explosion energy", "Thermal energy"], "activities": ["Process operation"],
        "keywords": ["furnace", "oxyfuel", "ignition", "flame", "hot work"],
    },
    "Work Authorisation": {
        "keywords": ["permit to work", "work permit", "authorization", "authorisation"],
    },
    "Bypassing Safety Controls": {
        "keywords": ["bypassed", "override", "disabled", "bonnet open", "not blocked", "not isolated"],
    },
}

# Label-based rules v0.2.
LABELS_V02 = {
    "Work at Height": {
        "hazards": ["Fall-from-height energy"], "exposures": ["Fall exposure"], "activities": ["Working at height"],
        "keywords": ["ladder", "scaffold", "height", "reel", "chimney", "vertical opening"],
    },
    "Isolation": {
        "hazards": ["Electrical energy", "Mechanical / moving equipment energy", "Pressure / stored energy"],
        "keywords": [
            "energized", "energised", "live", "lockout", "loto", "isolation", "isolated", "de-energized",
            "deenergized", "bonnet open", "operating",
        ],
    },
    "Line of Fire": {
        "hazards": [
            "Falling object / dropped object energy", "Vehicle / mobile equipment energy",
            "Pressure / stored energy", "Thermal energy", "Fire / explosion energy",
            "Mechanical / moving equipment energy",
        ],
        "exposures": ["Line-of-fire exposure"],
        "keywords": [
            "projection", "projected", "line of fire", "trajectory", "released", "ejected", "expelled", "struck",
            "impact",
        ],
    },
    "Seat Belt": {"hazards": ["Vehicle / mobile equipment energy"], "keywords": ["seat belt", "safety belt"]},
    "Driving": {
        "hazards": ["Vehicle / mobile equipment energy"], "activities": ["Driving / vehicle movement"],
        "keywords": ["driving", "reversing", "reversed", "backing", "transit", "distracted"],
    },
    "Safe Mechanical Lifting": {
        "hazards": ["Falling object / dropped object energy"], "activities": ["Lifting / handling"],
        "keywords": ["lifting", "lifted", "rigging", "load", "suspended"],
    },
    "Confined Space": {"keywords": ["confined space", "inside the chute", "discharge chute", "restricted space"]},
    "Hot Work": {
        "hazards": ["Thermal energy", "Fire / explosion energy"],
        "keywords": ["furnace", "oxyfuel", "ignition", "flame", "hot work"],
    },
    "Work Authorisation": {
        "keywords": ["permit to work", "work permit", "authorization", "authorisation"],
    },
    "Bypassing Safety Controls": {
        "keywords": ["bypassed", "override", "not isolated", "not blocked", "bonnet open"],
    },
}

# Labels of the reasoning scores.
HIGH_ENERGY = [
    "Electrical energy", "Pressure / stored energy", "Thermal energy", "Fire / explosion energy",
    "Vehicle / mobile equipment energy", "Falling object / dropped object energy", "Fall-from-height energy",
    "Caught-between / pinch energy",
]
SEVERE_ACTUAL = ["Fatality", "Electrical injury", "Crushing / amputation"]
MILD_ACTUAL = [
    "Cut / laceration", "Minor irritation / swelling", "Musculoskeletal injury", "Struck-by / impact injury",
]
HIGH_ENERGY_V02 = HIGH_ENERGY + ["Mechanical / moving equipment energy"]

# The first generation of the rules; terms stay in bank order in its output.
FIRST = {name: dict(rule) for name, rule in EXACT.items()}
FIRST["Bypassing Safety Controls"]["terms"] = ["safety control", "override", "bypass", "disable", "barrier"]
FIRST["Driving"]["terms"] = ["vehicle", "truck", "driver", "driving", "road", "collision", "run over"]
FIRST["Hot Work"]["words"] = ["hot", "oxyfuel"]
FIRST["Safe Mechanical Lifting"]["terms"] = ["lifting", "lifted", "suspended load", "crane", "rigging", "load"]
FIRST["Work Authorisation"]["terms"] = ["permit", "authorisation", "authorization", "work permit"]
