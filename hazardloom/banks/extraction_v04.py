"""Extraction bank v0.4: (label, pattern) in output order."""

# Fixed values.
HAZARDS = [
    ("Electrical energy", r"\b(?:\d{2,4}\s*v(?:olt)?s?|\d{2,5}\s*a(?:mp)?s?|electrical|electric|energized?|live|phase[- ]to[- ]phase|phase[- ]to[- ]ground|short[- ]circuit|arc(?:ing)?|thermomagnetic)\b"),
    ("Mechanical / moving equipment energy", r"\b(?:blade|cutter|cutting machine|fan|conveyor|rotating|rotation|moving equipment|moving part|mechanical|shaft|roller|belt|pulley|gear|motor)\b"),
    ("Pressure / stored pressure", r"\b(?:pressure|pressurized|compressed air|steam|hydraulic|pneumatic|pressure line|pressurized line)\b"),
    ("Chemical energy / hazardous substance", r"\b(?:acid|sulfuric|sulphuric|nitric|hydrochloric|caustic|ammonia|chemical|solvent|chlorine|toxic|corrosive|alkali|chemical solution)\b"),
    ("Thermal energy", r"\b(?:hot gas|hot metal|hot liquid|molten|liquid metal|heat|heated|steam|high temperature|thermal|burning|scald)\b"),
    ("Fire / explosion energy", r"\b(?:fire|flame|explosion|explosive|ignition|flash fire|flash|combustible|flammable)\b"),
    ("Vehicle / mobile equipment energy", r"\b(?:vehicle|truck|car|bus|forklift|loader|excavator|crane|mobile equipment|reversing|reversed|backing|moving vehicle)\b"),
    ("Falling-object / dropped-object energy", r"\b(?:falling object|dropped object|dropped load|rock block|rock slab|stone|metal fragment|fragment|splinter|falling material|fall(?:en|ing) from)\b"),
    ("Fall-from-height energy", r"\b(?:fall from height|fell from|falling from|ladder|scaffold|scaffolding|rooftop|roof|platform|elevated|height|above ground)\b"),
    ("Caught-between / pinch energy", r"\b(?:caught[- ]between|pinch|trapped|imprisoned|caught|crushed between|finger.*(?:caught|trapped|imprisoned)|hand.*(?:caught|trapped|imprisoned))\b"),
    ("Manual handling / ergonomic energy", r"\b(?:lifting|manual handling|carrying|heavy object|awkward posture|reaching|pulling|pushing|twisting)\b"),
    ("Biological / animal exposure", r"\b(?:bite|snake|animal|insect|bee|wasp|dog)\b"),
    ("Sharp-object energy", r"\b(?:knife|sharp edge|sharp object|broken glass|glass shard|blade|metal edge)\b"),
]

EXPOSURES = [
    ("Direct worker exposure", r"\b(?:worker|operator|mechanic|employee|collaborator|person|technician|man)\b.{0,70}\b(?:reached|exposed|contact|hit|struck|splashed|touched|injured|injury|burn|cut|graz(?:ed|ing))\b"),
    ("Electrical exposure", r"\b(?:touch(?:ed|ing)?|contact|reached|phase[- ]to[- ](?:phase|ground)|energized?|live).{0,70}\b(?:electrical|electric|panel|wire|cable|conductor|voltage|volt|amp)\b|\b(?:electrical|electric).{0,70}\b(?:touch|contact|shock|reached|exposed)\b"),
    ("Chemical exposure", r"\b(?:acid|sulfuric|sulphuric|nitric|ammonia|chemical|solvent|caustic|corrosive).{0,100}\b(?:splash(?:ed)?|spill(?:ed)?|drop(?:ped)?|contact|touched|reached|face|eye|skin|body|upper limbs?)\b"),
    ("Thermal exposure", r"\b(?:hot gas|hot metal|molten|liquid metal|steam|heat|heated).{0,90}\b(?:face|eye|hand|arm|worker|operator|person|contact|reached|splashed|project(?:ed|ion)?)\b"),
    ("Line-of-fire exposure", r"\b(?:line[- ]of[- ]fire|in the trajectory|trajectory|projection|projected|released|thrown|ejected|struck|hit)\b"),
    ("Caught-between / pinch exposure", r"\b(?:caught[- ]between|pinch|trapped|imprisoned|caught|crushed between|finger.*(?:caught|trapped|imprisoned)|hand.*(?:caught|trapped|imprisoned))\b"),
    ("Fall exposure", r"\b(?:fell|fall(?:ing)?|fall from|ladder|scaffold|height|roof|platform).{0,100}\b(?:worker|operator|person|employee|mechanic|technician)\b"),
    ("Body part contact", r"\b(?:finger|hand|arm|forearm|face|eye|head|leg|foot|right hand|left hand|upper limb|body part)\b.{0,75}\b(?:contact|graz(?:ed|ing)|hit|struck|cut|injur|touch|embedded|imprisoned|trapped)\b"),
    ("Vehicle exposure", r"\b(?:reversing|reversed|backing|vehicle|truck|forklift|loader|car|mobile equipment).{0,100}\b(?:worker|operator|person|employee|mechanic|technician|hit|struck|near|contact)\b"),
]

CONSEQUENCES = [
    ("Fatality", r"\b(?:fatal|fatality|death|died|dead|killed|loss of life)\b"),
    ("Electrical injury", r"\b(?:electric shock|electrical shock|electrocution|electrical injury|electric injury|shock)\b"),
    ("Crushing / amputation", r"\b(?:crush(?:ed|ing)?|crushing|amputation|amputat(?:ed|ion)|severed|imprisoned|trapped between|crushed between)\b"),
    ("Burn / thermal injury", r"\b(?:burn(?:ed)?|burn injury|thermal injury|scald(?:ed)?|heat injury)\b"),
    ("Chemical injury", r"\b(?:chemical burn|acid burn|corrosive burn|chemical injury|burn(?:ed)?).{0,80}\b(?:acid|chemical|sulfuric|sulphuric|nitric|ammonia|caustic|corrosive)\b|\b(?:acid|sulfuric|sulphuric|nitric|ammonia|chemical).{0,80}\b(?:burn|injur)\b"),
    ("Cut / laceration", r"\b(?:cut|cuts|cutting|laceration|lacerated|incision|wound|blunt cut|small cuts?)\b"),
    ("Struck-by injury", r"\b(?:hit|struck|struck-by|impact|impacted|graz(?:ed|ing)|blunt trauma)\b"),
    ("Fall injury", r"\b(?:fell|fall(?:en)?|fall injury|fall from|falling).{0,100}\b(?:injur|trauma|pain|fracture|swelling|wound|hurt)\b"),
    ("Eye / facial injury", r"\b(?:eye|face|facial).{0,70}\b(?:injur|irritat|pain|hit|splash|contact|wound|burn)\b"),
    ("Respiratory / inhalation injury", r"\b(?:inhalation|inhaled|fumes|gas|smoke).{0,80}\b(?:injur|irritat|expos|breath|respirat)\b"),
    ("Serious / potentially serious injury", r"\b(?:serious injury|severe injury|seriously injured|potentially serious|hospitali[sz]ed|fracture|amputation|loss of consciousness|unconscious)\b"),
    ("Minor injury / irritation", r"\b(?:minor injury|minor|superficial injury|little trauma|small cuts?|swelling|irritation|irritated|scratch(?:ed)?|bruise)\b"),
]

BARRIERS = [
    ("PPE", r"\b(?:helmet|hard hat|gloves?|goggles?|safety glasses|face shield|faceshield|respirator|mask|earplugs?|ear protection|safety shoes|boots|ppe|personal protective equipment)\b"),
    ("Guard / physical protection", r"\b(?:guard|guarding|protector|protective guard|cover|shield|barrier|screen|enclosure|fence)\b"),
    ("Isolation / LOTO", r"\b(?:lockout|lock[- ]out|tagout|tag[- ]out|loto|isolation|isolated|isolate|electrically isolated)\b"),
    ("De-energization", r"\b(?:de[- ]energized|deenergized|power off|switched off|shut down|shutdown|disconnected|breaker off|breaker disconnected)\b"),
    ("Fall protection", r"\b(?:harness|fall arrest|lifeline|lanyard|guardrail|handrail|toe board)\b"),
    ("Traffic control / exclusion zone", r"\b(?:barricade|barricaded|exclusion zone|restricted area|spotter|banksman|flagman|traffic control|cordoned off)\b"),
    ("Permit / authorization", r"\b(?:permit to work|work permit|permit|authorized|authori[sz]ed)\b"),
    ("Procedure / JSA", r"\b(?:procedure|safe work method|method statement|job safety analysis|jsa|jha|risk assessment|checklist|instruction)\b"),
    ("Supervision", r"\b(?:supervisor|supervision|supervised|foreman)\b"),
]

FAILURES = [
    ("PPE", r"\b(?:without|no|not wearing|failed to wear|missing|lack of)\b.{0,40}\b(?:helmet|gloves?|goggles?|safety glasses|face shield|mask|respirator|ppe|personal protective equipment)\b"),
    ("Guard / physical protection", r"\b(?:without|no|missing|removed|removed the|failed|failure|not in place|bypassed|bypass(?:ed)?)\b.{0,50}\b(?:guard|guarding|protector|cover|shield|barrier|enclosure)\b"),
    ("Isolation / LOTO", r"\b(?:without|no|not|failed|failure|missing|not isolated|not lock(?:ed)? out|not tagged)\b.{0,60}\b(?:isolation|isolat(?:ed|ion)|lockout|lock[- ]out|tagout|tag[- ]out|loto)\b"),
    ("De-energization", r"\b(?:still energized|remained energized|not de[- ]energized|without shutting down|without switching off|without disconnecting|power remained on)\b"),
    ("Fall protection", r"\b(?:without|no|missing|not using|not wearing|failed to use)\b.{0,50}\b(?:harness|fall arrest|lifeline|lanyard|guardrail|handrail)\b"),
    ("Traffic control / exclusion zone", r"\b(?:without|no|missing|not established|not barricaded|not cordoned)\b.{0,60}\b(?:exclusion zone|barricade|barricaded|restricted area|spotter|banksman|traffic control)\b"),
]

ACTIVITIES = [
    ("Assembly / installation", r"\b(?:assembly|assembling|installation|installing|installed|mounting)\b"),
    ("Adjustment / tightening", r"\b(?:adjustment|adjusting|tightening|loosen(?:ing)?|setting)\b"),
    ("Maintenance / repair", r"\b(?:maintenance|maintaining|repair|repairing|overhaul|servicing|service)\b"),
    ("Inspection", r"\b(?:inspection|inspecting|inspect|checking|check)\b"),
    ("Cleaning", r"\b(?:cleaning|clean|washing|washing down)\b"),
    ("Painting / coating", r"\b(?:painting|paint|coating|coated)\b"),
    ("Lifting / handling", r"\b(?:lifting|lifted|lifting operation|rigging|handling|carrying)\b"),
    ("Excavation / earthwork", r"\b(?:excavation|excavating|trenching|earthwork|digging)\b"),
    ("Working at height", r"\b(?:working at height|ladder|scaffold|scaffolding|roof|rooftop|elevated platform)\b"),
    ("Driving / vehicle movement", r"\b(?:driving|reversing|reversed|backing|vehicle movement|moving vehicle)\b"),
    ("Drilling / cutting", r"\b(?:drilling|drill|cutting|cutter|sawing|grinding)\b"),
    ("Electrical work", r"\b(?:electrical work|electrical installation|wiring|panel work|testing electrical)\b"),
]

# Words that signal a missing barrier near its mention, and cues of inferred exposure.
NEGATION = r"\b(?:without|no|not|missing|removed|failed|failure|lack|bypassed|bypass)\b"
HUMAN = r"(worker|operator|mechanic|employee|person|collaborator|technician|man|finger|hand|arm|face|eye|leg|foot)"
INJURY = r"(injur|hurt|pain|burn|cut|graz|hit|struck|splashed|contact|touched|embedded)"
FLASH_CONTEXT = ["fire", "flame", "ignition", "explosion", "combust", "gas"]
HEAT_CONTEXT = r"hot|heat|thermal|steam|molten|metal|gas|burn"
FATALITY = r"\b(?:fatal|fatality|death|died|dead|killed|loss of life)\b"
CAUGHT = r"\b(?:caught[- ]between|imprisoned between|crushed between)\b"

# Labels behind the derived signals.
DIRECT_EXPOSURE = [
    "Direct worker exposure", "Electrical exposure", "Chemical exposure", "Thermal exposure",
    "Line-of-fire exposure", "Caught-between / pinch exposure", "Vehicle exposure", "Fall exposure",
]
SEVERE = ["Fatality", "Crushing / amputation", "Electrical injury", "Serious / potentially serious injury"]
HIGH_ENERGY = [
    "Electrical energy", "Pressure / stored pressure", "Thermal energy", "Fire / explosion energy",
    "Vehicle / mobile equipment energy", "Falling-object / dropped-object energy", "Fall-from-height energy",
    "Caught-between / pinch energy",
]
