"""Ontology of the sentence extractor v0.3: family -> key -> (label, patterns, priority), and its guard rails."""

from hazardloom.banks.ontology_v02 import ONTOLOGY as _V02

# Patterns per key, tried in this order within a sentence.
ONTOLOGY = {
    "hazards": {
        "electrical_energy": ("Electrical energy", [
            r"\b\d+\s*v\b.*\b(electric|panel|board|equipment|installation)\b",
            r"\belectric(al)?\s+(board|panel|equipment|installation)\b", r"\benergiz(e|ed|ing|ation)\b",
            r"\barc[\s-]?flash\b", r"\bphase\s*(to|-)\s*ground\b", r"\belectric shock\b", r"\belectrocution\b",
            r"\bhigh voltage\b", r"\bpower cord\b",
        ], 6),
        "mechanical_energy": ("Mechanical / moving equipment energy", [
            r"\brotat(ing|ion)\b", r"\bmoving\s+(equipment|machine|part)\b", r"\bcutter blade\b",
            r"\bblade\b.*\b(detached|released|slip|hit|cut)\b", r"\bmachine\b.*\b(started|move|moving)\b",
            r"\bmechanical\b", r"\bpinch(ed|ing)?\b", r"\bcrush(ing|ed)?\b", r"\bentangle(d|ment)?\b",
        ], 5),
        "pressure_process_energy": ("Pressure / process energy", [
            r"\bpressurized\b", r"\bpressurised\b", r"\bstored pressure\b",
            r"\bpressure\b.*\b(release|rupture|line|piping)\b", r"\bprocess line\b",
            r"\bpipe\b.*\b(pressure|release|rupture)\b", r"\bpiping\b.*\b(pressure|release|rupture)\b",
        ], 5),
        "thermal_energy": ("Thermal / hot material", [
            r"\bhot gas\b", r"\bhot pulp\b", r"\bhot material\b", r"\bthermal\b", r"\bhigh temperature\b",
            r"\bburn(ed|s)?\b.*\b(hot|gas|material|thermal)\b", r"\bfurnace\b.*\b(gas|heat|hot)\b", r"\bmolten\b",
        ], 5),
        "gravity_fall_energy": ("Gravity / fall-from-height energy", [
            r"\bfall from height\b", r"\bfalling from\b", r"\bheight of \d+\s*(m|meters?)\b",
            r"\bat an approximate height\b", r"\bvertical opening\b", r"\bopen shaft\b", r"\bchimney\b",
            r"\bfell\b.*\b\d+\s*(m|meters?)\b",
        ], 6),
        "ground_rock_energy": ("Ground / rockfall energy", [
            r"\bfalling rock\b", r"\brockfall\b", r"\brock block\b", r"\bstone slab\b", r"\bslab\b.*\bdetached\b",
            r"\bunstable (ground|roof|rock)\b", r"\bground movement\b", r"\bground fall\b", r"\brock\b.*\bdetached\b",
            r"\broof\b.*\bdetached\b",
        ], 6),
        "mobile_equipment_energy": ("Mobile equipment / vehicle movement", [
            r"\bwheel[\s-]?loader\b", r"\bmobile equipment\b", r"\bvehicle\b.*\b(worker|employee|operator)\b",
            r"\bloader\b.*\b(worker|employee|operator)\b", r"\btire\b.*\b(worker|employee|operator)\b",
            r"\bvehicle\b.*\bmovement\b",
        ], 5),
        "chemical_exposure": ("Chemical substance / exposure", [
            r"\bpaint\b.*\b(face|eye|skin|exposure|contact)\b", r"\bchemical\b.*\b(exposure|contact|release)\b",
            r"\bsolvent\b.*\b(exposure|contact)\b", r"\bcorrosive\b.*\b(exposure|contact)\b",
        ], 4),
        "suspended_load": ("Suspended / falling load", [
            r"\bsuspended load\b", r"\bfalling load\b", r"\bcrane\b.*\b(load|hook|lift)\b",
            r"\bload\b.*\b(fell|falling|dropped)\b", r"\bobject\b.*\b(fell|falling|dropped)\b",
        ], 5),
        "fire_explosion": ("Fire / explosion energy", [
            r"\bexplosion\b", r"\bexplosive\b", r"\bfire\b.*\b(event|ignition|explosion)\b", r"\bignit(e|ed|ion|ing)\b",
        ], 5),
        "biological_hazard": ("Biological / animal hazard", [
            r"\bbees?\b", r"\bstung\b", r"\bsting\b", r"\bbites?\b", r"\bvenomous\b", r"\bsnake\b",
        ], 3),
    },
    "exposures": {
        "direct_exposure": ("Direct worker exposure", [
            r"\breaches?\b.*\b(worker|operator|employee|collaborator)\b",
            r"\breach(?:es|ed)?\s+the\s+(operator|worker|employee)\b", r"\bcausing the injury\b",
            r"\bcausing.*\binjury\b", r"\bdirectly exposed\b", r"\bexposed to\b",
        ], 6),
        "body_part_contact": ("Body part contact", [
            r"\b(grazing|grazed|hit|struck|touch(ed)?|rub(bed|bing)?)\b.*\b(hand|arm|leg|face|eye|head|finger|foot|thumb)\b",
            r"\b(hand|arm|leg|face|eye|head|finger|foot|thumb)\b.*\b(grazed|hit|struck|burn|cut|contact|rubbed)\b",
            r"\b(right|left)\s+(hand|arm|leg|forearm|thumb|finger)\b.*\b(cut|hit|struck|grazed)\b",
        ], 6),
        "caught_between": ("Caught-between / pinch exposure", [
            r"\bimprisoned between\b", r"\btrapped between\b", r"\bcaught between\b",
            r"\bbetween\b.*\b(equipment|machine|vehicle|wall|rim)\b.*\band\b",
        ], 6),
        "line_of_fire": ("Line-of-fire exposure", [
            r"\bline of fire\b", r"\bin the path of\b", r"\bin the direction of\b",
            r"\bproject(ed|ile|ion)\b.*\b(worker|operator|employee)\b", r"\bstruck by\b",
        ], 6),
        "fall_exposure": ("Fall exposure", [
            r"\bworking\b.*\bheight of \d+\s*(m|meters?)\b", r"\bworking\b.*\b(at|from)\b.*\bheight\b",
            r"\bnear\b.*\b(vertical opening|chimney|shaft)\b", r"\badjacent to\b.*\b(opening|chimney|shaft)\b",
            r"\bfell\b.*\bheight\b",
        ], 5),
        "mobile_equipment_exposure": ("Pedestrian / mobile-equipment interaction", [
            r"\bon foot\b.*\b(loader|truck|vehicle)\b", r"\bcross(ed|ing)?\b.*\broad\b.*\b(loader|truck|vehicle)\b",
            r"\bworker\b.*\bbetween\b.*\b(equipment|machine|vehicle)\b",
            r"\boperator\b.*\bbetween\b.*\b(equipment|machine|vehicle)\b",
        ], 5),
        "material_contact": ("Material / substance contact", [
            r"\bpaint\b.*\bface\b", r"\bpaint\b.*\bskin\b", r"\bhot gas\b.*\bface\b",
            r"\bhot pulp\b.*\b(employee|worker|operator)\b", r"\bchemical\b.*\b(contact|exposure)\b",
        ], 5),
    },
    "consequences": {
        "fatality": ("Fatality", [r"\bfatality\b", r"\bdeath\b", r"\bdied\b", r"\bdead\b"], 7),
        "serious_injury": ("Serious / potentially serious injury", [
            r"\bserious injury\b", r"\bsevere injury\b", r"\blife[\s-]?altering\b", r"\btraumatic injury\b",
            r"\bmajor injury\b", r"\bfracture(d|s)?\b", r"\btrapped\b", r"\bimprisoned\b",
        ], 6),
        "crush_amputation": ("Crushing / amputation", [
            r"\bcrush(ing|ed)?\b", r"\bamputation\b", r"\btrapped between\b", r"\bcaught between\b",
            r"\bimprisoned between\b",
        ], 6),
        "electrical_injury": ("Electrical injury", [
            r"\belectric shock\b", r"\belectrocution\b", r"\barc[\s-]?flash\b.*\b(injury|operator|employee|worker)\b",
            r"\bflash\b.*\breach(es|ed)?\b.*\boperator\b",
        ], 6),
        "thermal_injury": ("Burn / thermal injury", [r"\bburn(ed|s)?\b", r"\bscald(ed|ing)?\b", r"\bthermal injury\b"], 4),
        "struck_by": ("Struck-by injury", [
            r"\bstruck by\b", r"\bwas hit\b", r"\bhit (him|her|the worker|the employee)\b",
            r"\bimpacted?\b.*\b(arm|leg|head|worker|employee)\b", r"\bgrazing\b.*\b(hand|arm|finger)\b",
            r"\bgrazed\b.*\b(hand|arm|finger)\b",
        ], 4),
        "cut_laceration": ("Cut / laceration", [
            r"\bcut(s)?\b.*\b(hand|finger|arm|thumb)\b", r"\bcut of\b.*\b(hand|finger|arm|thumb)\b",
            r"\blacerat(ed|ion)\b", r"\bblunt cut\b", r"\bsmall cuts?\b",
        ], 4),
        "minor_injury": ("Minor injury / irritation", [
            r"\blittle trauma\b", r"\bminor injury\b", r"\bswelling\b", r"\birritation\b", r"\brash\b",
        ], 3),
    },
    "barriers": {
        "isolation_loto": ("Isolation / lockout-tagout", [
            r"\blockout\b", r"\btagout\b", r"\bLOTO\b", r"\block\b.*\bremoved\b", r"\bisolation\b",
            r"\bde-energiz(e|ed|ation|ing)\b",
        ], 7),
        "guarding": ("Machine guarding", [
            r"\bguard(ing|ed)?\b.*\bmachine\b", r"\bmachine protection\b", r"\bprotective guard\b",
        ], 6),
        "fall_protection": ("Fall prevention / protection", _V02["barriers"]["fall_protection"][1], 6),
        "exclusion_control": ("Exclusion / barricading / separation", [
            r"\bbarricad(e|ed|ing)\b", r"\bexclusion zone\b", r"\bmarked with tape\b", r"\bcontrolled access\b",
            r"\bseparation\b.*\b(worker|equipment|vehicle)\b", r"\bcones\b.*\bwarning\b",
        ], 5),
        "pressure_isolation": ("Pressure isolation / depressurization", [
            r"\bdepressuriz(e|ation|ed)\b", r"\bdepressurise\b", r"\bpressure verification\b", r"\bpositive isolation\b",
            r"\bbleed(ing)?\b.*\bline\b", r"\bdrain(ing)?\b.*\bline\b",
        ], 6),
        "ground_control": ("Ground control / scaling", _V02["barriers"]["ground_control"][1], 6),
        "electrical_protection": ("Electrical protection", [
            r"\belectrical isolation\b", r"\babsence[- ]of[- ]voltage\b", r"\babsence of voltage\b",
            r"\barc[\s-]?flash PPE\b", r"\belectrical protective equipment\b", r"\belectrical protection\b",
        ], 7),
        "personal_protective_equipment": ("Personal protective equipment", [
            r"\bprotective equipment\b", r"\bPPE\b", r"\bsafety gloves\b", r"\bprotective gloves\b",
            r"\bgloves\b.*\b(protection|protective)\b",
        ], 3),
        "procedure_work_control": ("Procedure / work control", [
            r"\bprocedure\b", r"\bpermit\b.*\bwork\b", r"\bJSA\b", r"\bjob safety analysis\b", r"\bwork permit\b",
        ], 2),
    },
    "activities": {
        **_V02["activities"],
        "assembly_installation": ("Assembly / installation", [
            r"\binstall(ation|ing)\b", r"\bassembly\b", r"\bassembling\b",
        ], 3),
    },
}

# Wording, priorities and word counts that make high and medium confidence.
STRONG = [
    "440v", "arc flash", "lock removed", "imprisoned between", "trapped between", "caught between", "vertical opening",
    "fall from height", "fall protection", "ground control", "electric shock", "electrocution", "fatality", "death",
    "line of fire",
]
HIGH_PRIORITY, HIGH_WORDS, MEDIUM_PRIORITY = 6, None, 4

# Fixed values: (family, key) dropped when a phrase stands in the narrative, or unless a pattern hits it.
DROP_IF = {("hazards", "fire_explosion"): ["phase to ground", "phase-to-ground", "440v"]}
DROP_UNLESS = {
    ("hazards", "gravity_fall_energy"): r"\b(vertical opening|open shaft|chimney|fall from height|height of \d+)",
    ("hazards", "pressure_process_energy"): r"\b(pressurized|pressurised|stored pressure|pressure release|pressure rupture|process line|piping.*(pressure|release|rupture)|pipe.*(pressure|release|rupture))\b",
    ("barriers", "personal_protective_equipment"): r"\b(safety gloves|protective gloves|gloves.*(protection|protective)|protective equipment|PPE)\b",
}
