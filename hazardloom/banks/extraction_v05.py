"""Extraction bank v0.5: (label, pattern) in output order."""

# Fixed values.
HAZARDS = [
    ("Electrical", r"\b(?:\d{2,4}\s*v|\d{2,5}\s*a|electrical|electric|energized|live|phase[- ]to[- ]phase|phase[- ]to[- ]ground|arc|thermomagnetic)\b"),
    ("Mechanical / moving equipment", r"\b(?:blade|cutter|fan|conveyor|rotating|rotation|moving equipment|moving part|shaft|roller|belt|pulley|gear|motor|propeller)\b"),
    ("Pressure / stored pressure", r"\b(?:pressure|pressurized|compressed air|hydraulic|pneumatic|steam|pressure line)\b"),
    ("Chemical", r"\b(?:acid|sulfuric|sulphuric|nitric|hydrochloric|caustic|ammonia|chemical|solvent|chlorine|corrosive|thinner)\b"),
    ("Thermal", r"\b(?:hot gas|hot metal|molten|liquid metal|steam|heat|heated|high temperature|thermal|scald)\b"),
    ("Fire / explosion", r"\b(?:fire|flame|explosion|ignition|combustible|flammable|flash fire)\b"),
    ("Vehicle / mobile equipment", r"\b(?:vehicle|truck|car|bus|forklift|loader|excavator|mobile equipment|reversing|reversed|backing|tanker)\b"),
    ("Falling object / rockfall", r"\b(?:falling object|dropped object|rock block|rock slab|stone slab|stone|metal fragment|splinter|falling material|detachment|detached)\b"),
    ("Fall from height", r"\b(?:fall from height|fell from|falling from|ladder|scaffold|roof|platform|height|reel)\b"),
    ("Caught-between / pinch", r"\b(?:caught[- ]between|pinch|trapped|imprisoned|caught|crushed between|finger.*(?:caught|trapped|imprisoned)|hand.*(?:caught|trapped|imprisoned))\b"),
    ("Sharp object", r"\b(?:knife|sharp edge|sharp corner|sharp object|broken glass|glass shard|blade|metal edge|machete)\b"),
    ("Biological / animal", r"\b(?:bite|snake|animal|insect|bee|wasp|thorn)\b"),
    ("Ground / unstable terrain", r"\b(?:unstable ground|ground support|rock block|rockfall|pit|gallery|gable|loose ground)\b"),
]

EXPOSURES = [
    ("Direct contact", r"\b(?:contact|touched|touches|reached|hits|hit|struck|splashed|projection|projected|grazed|injured)\b"),
    ("Line-of-fire", r"\b(?:line[- ]of[- ]fire|trajectory|projected|projection|released|ejected|thrown|struck|hit)\b"),
    ("Caught-between / pinch", r"\b(?:caught[- ]between|pinch|trapped|imprisoned|caught|crushed between|finger.*(?:caught|trapped|imprisoned)|hand.*(?:caught|trapped|imprisoned))\b"),
    ("Fall exposure", r"\b(?:fell|falling|fall from|ladder|scaffold|height|reel)\b"),
    ("Chemical exposure", r"\b(?:acid|sulfuric|sulphuric|nitric|ammonia|chemical|caustic|corrosive|thinner).{0,100}\b(?:splash|spill|projection|contact|face|eye|skin|body|lip|arm|leg)\b"),
    ("Thermal exposure", r"\b(?:hot gas|hot metal|molten|liquid metal|steam|heat|heated).{0,100}\b(?:face|eye|hand|arm|worker|operator|person|contact|reached|projection)\b"),
    ("Vehicle exposure", r"\b(?:vehicle|truck|loader|tanker|reversing|reversed|backing).{0,100}\b(?:worker|operator|person|employee|hit|struck|collision|crash)\b"),
]

ACTUAL = [
    ("Fatality", r"\b(?:fatal|fatality|death|died|dead|killed|verify the death)\b"),
    ("Electrical injury", r"\b(?:electric shock|electrical shock|electrocution|electrical injury|electric injury|shock)\b"),
    ("Crushing / amputation", r"\b(?:crush(?:ed|ing)?|crushing|amputation|amputated|severed|atri(?:c|t)ion|imprisoned between|trapped between)\b"),
    ("Burn / thermal injury", r"\b(?:burn(?:ed)?|burn injury|thermal injury|scald(?:ed)?|redness and burning)\b"),
    ("Chemical injury", r"\b(?:chemical burn|acid burn|corrosive burn|chemical injury|burn).{0,80}\b(?:acid|chemical|sulfuric|sulphuric|nitric|ammonia|caustic|corrosive|thinner)\b"),
    ("Cut / laceration", r"\b(?:cut|cuts|cutting|laceration|lacerated|wound|blunt cut|small cuts?|puncture|pierced)\b"),
    ("Struck-by / impact injury", r"\b(?:hit|struck|impact|impacted|grazed|blunt trauma|contusion|bruise)\b"),
    ("Fall injury", r"\b(?:fell|fall(?:en)?).{0,100}\b(?:injur|trauma|pain|fracture|swelling|wound|hurt|concussion|forearm|knee|back)\b"),
    ("Eye / facial injury", r"\b(?:eye|face|facial).{0,80}\b(?:injur|irritat|pain|hit|splash|contact|wound|burn|redness)\b"),
    ("Musculoskeletal injury", r"\b(?:sprain|strain|twist|twisted|lumbar pain|overexertion|musculoskeletal)\b"),
    ("Minor irritation / swelling", r"\b(?:swelling|irritation|irritated|scratch|minor|superficial injury|little trauma|redness)\b"),
]

POTENTIAL = [
    ("Potential severe fall injury", r"\b(?:height|ladder|scaffold|reel|chimney|vertical opening).{0,120}\b(?:fall|fell|falls)\b"),
    ("Potential severe electrical injury", r"\b(?:440\s*v|400\s*a|electrical|energized|live|phase[- ]to[- ]ground|arc).{0,120}\b(?:worker|operator|employee|contact|shock|flash|injur|reached)\b"),
    ("Potential severe caught-between injury", r"\b(?:caught[- ]between|imprisoned|trapped|pinch|crushed between).{0,100}\b(?:hand|finger|leg|chest|worker|mechanic|operator)\b"),
    ("Potential severe vehicle injury", r"\b(?:vehicle|truck|tanker|loader|mobile equipment).{0,120}\b(?:crash|collision|roll|turns|reverse|reversing|slides|excavated)\b"),
    ("Potential severe chemical exposure", r"\b(?:sulfuric|sulphuric|nitric|ammonia|corrosive|chemical).{0,120}\b(?:projection|splash|splashes|face|eye|upper limbs|skin|reaches)\b"),
    ("Potential severe thermal injury", r"\b(?:hot gas|molten|liquid metal|steam|high temperature).{0,120}\b(?:reaching|reaches|projection|projected|face|worker|employee)\b"),
    ("Potential severe projectile injury", r"\b(?:splinter|fragment|rock block|rock slab|metal fragment).{0,120}\b(?:project|expell|impact|hit|struck|worker|employee|operator)\b"),
]

BARRIERS = [
    ("PPE", r"\b(?:helmet|hard hat|gloves?|goggles?|safety glasses|face shield|faceshield|respirator|mask|safety shoes|boots|ppe|epps)\b"),
    ("Guard / physical protection", r"\b(?:guard|guarding|protector|protective guard|cover|shield|barrier|screen|enclosure|fence|fender)\b"),
    ("Isolation / LOTO", r"\b(?:lockout|lock[- ]out|tagout|tag[- ]out|loto|isolation|isolated|isolate|disabled)\b"),
    ("De-energization", r"\b(?:de[- ]energized|deenergized|power off|switched off|shut down|shutdown|disconnected|breaker off)\b"),
    ("Fall protection", r"\b(?:harness|fall arrest|lifeline|lanyard|guardrail|handrail|toe board)\b"),
    ("Exclusion / traffic control", r"\b(?:barricade|barricaded|exclusion zone|restricted area|spotter|banksman|flagman|traffic control|cordoned)\b"),
    ("Permit / authorization", r"\b(?:permit to work|work permit|authorized|authorised)\b"),
    ("Procedure / JSA / risk assessment", r"\b(?:procedure|method statement|job safety analysis|jsa|jha|risk assessment|checklist|instruction)\b"),
]

GAPS = [
    ("PPE", r"\b(?:without|no|not wearing|did not have|did not use|not using|lack of|missing)\b.{0,45}\b(?:helmet|gloves?|goggles?|safety glasses|face shield|mask|respirator|ppe|epps)\b"),
    ("Guard / physical protection", r"\b(?:without|no|missing|removed|not in place|bypassed)\b.{0,55}\b(?:guard|guarding|protector|cover|shield|barrier|enclosure)\b"),
    ("Isolation / LOTO", r"\b(?:without|no|not|failed|failure|missing|not isolated|not lock(?:ed)? out|not tagged)\b.{0,60}\b(?:isolation|isolat(?:ed|ion)|lockout|lock[- ]out|tagout|tag[- ]out|loto)\b"),
    ("De-energization", r"\b(?:still energized|remained energized|not de[- ]energized|without shutting down|without switching off|without disconnecting|power remained on)\b"),
    ("Fall protection / safe access", r"\b(?:unstable reel|rim position|improvised|without.*(?:ladder|platform)|fell.*ladder|fall(?:ing)?.{0,40}ladder)\b"),
    ("Exclusion / line-of-fire control", r"\b(?:in the line of fire|line[- ]of[- ]fire|person.*inside.*(?:fenced|restricted)|remain(?:ed)? in the exposure area|no presence of personnel|not blocked)\b"),
    ("Structural / ground control", r"\b(?:broken.*(?:anchor|support|rivet)|rock block displacement|stone slab.*detached|unstable ground|loose.*ground)\b"),
]

ACTIVITIES = [
    ("Inspection", r"\b(?:inspection|inspecting|inspect|checking|check|survey)\b"),
    ("Assembly / installation", r"\b(?:assembly|assembling|installation|installing|installed|mounting)\b"),
    ("Maintenance / repair", r"\b(?:maintenance|repair|repairing|overhaul|servicing|service|repair work)\b"),
    ("Adjustment / tightening", r"\b(?:adjustment|adjusting|tightening|loosen(?:ing)?)\b"),
    ("Cleaning", r"\b(?:cleaning|clean|washing|washing down)\b"),
    ("Painting / coating", r"\b(?:painting|paint|coating)\b"),
    ("Lifting / handling", r"\b(?:lifting|lifted|rigging|handling|carrying)\b"),
    ("Working at height", r"\b(?:working at height|ladder|scaffold|roof|rooftop|elevated|reel)\b"),
    ("Driving / vehicle movement", r"\b(?:driving|reversing|reversed|backing|vehicle movement|transit)\b"),
    ("Cutting / drilling / grinding", r"\b(?:cutting|cutter|drilling|drill|grinding|machete)\b"),
    ("Process operation", r"\b(?:furnace|autoclave|hopper|conveyor|pump|tank|chute)\b"),
]
