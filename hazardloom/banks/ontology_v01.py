"""Ontology of the sentence extractor v0.1: family -> key -> (label, patterns)."""

# Patterns per key, tried in this order within a sentence.
ONTOLOGY = {
    "hazards": {
        "electrical_energy": ("Electrical energy", [
            r"\belectri(c|cal)\b", r"\benergized\b", r"\barc[\s-]?flash\b", r"\belectrocution\b", r"\belectric shock\b",
            r"\bpower cord\b", r"\b440\s*v\b", r"\bhigh voltage\b",
        ]),
        "mechanical_energy": ("Mechanical / rotational energy", [
            r"\brotat(ing|ion)\b", r"\bfan\b", r"\bpropeller\b", r"\bmachin(e|ery)\b", r"\bcrush(ing|ed)?\b",
            r"\bentangle(d|ment)?\b", r"\bamputation\b",
        ]),
        "pressure_process_energy": ("Pressure / process energy", [
            r"\bpressure\b", r"\bpressurized\b", r"\bpressurised\b", r"\bstored energy\b", r"\brelease\b",
            r"\brupture(d)?\b", r"\bpiping\b", r"\bflange\b",
        ]),
        "thermal_energy": ("Thermal / hot material", [
            r"\bhot gas\b", r"\bhot pulp\b", r"\bthermal\b", r"\bheat\b", r"\bhot\b", r"\bburn(ed|s)?\b",
            r"\bscald(ing|ed)?\b",
        ]),
        "gravity_fall_energy": ("Gravity / fall-from-height energy", [
            r"\bfall\b", r"\bfell\b", r"\bfalling\b", r"\bheights?\b", r"\bheight\b", r"\bvertical opening\b",
            r"\bchimney\b", r"\bladder\b", r"\bplatform\b",
        ]),
        "ground_rock_energy": ("Ground / rockfall energy", [
            r"\brockfall\b", r"\bfalling rock\b", r"\brock\b", r"\bslab\b", r"\bunstable ground\b",
            r"\bunstable roof\b", r"\bground\s*fall\b", r"\bground movement\b", r"\broof\b",
        ]),
        "mobile_equipment_energy": ("Mobile equipment / vehicle movement", [
            r"\btruck\b", r"\bloader\b", r"\bwheel[\s-]?loader\b", r"\bvehicle\b", r"\bmobile equipment\b", r"\btire\b",
            r"\broadway\b", r"\brun[\s-]?over\b",
        ]),
        "chemical_exposure": ("Chemical substance / exposure", [
            r"\bchemical\b", r"\bpaint\b", r"\bsolvent\b", r"\btoxic\b", r"\bcorrosive\b", r"\bsubstance\b",
        ]),
        "suspended_load": ("Suspended / falling load", [
            r"\bsuspended load\b", r"\bfalling load\b", r"\blift(ed|ing)?\b", r"\bcrane\b", r"\bhook\b",
            r"\bpump\b.*\bfall(s|en)?\b",
        ]),
        "fire_explosion": ("Fire / explosion energy", [
            r"\bfire\b", r"\bflame\b", r"\bexplosion\b", r"\bexplosive\b", r"\bignit(e|ion|ed)\b", r"\bigniting\b",
        ]),
        "biological_sting": ("Biological / animal hazard", [
            r"\bbees?\b", r"\bsting\b", r"\bbites?\b", r"\bsnake\b", r"\bvenomous\b", r"\binsect\b",
        ]),
    },
    "exposures": {
        "direct_worker_exposure": ("Worker directly exposed", [
            r"\bworker\b.*\bexpos(ed|ure)\b", r"\bdirectly exposed\b", r"\bwas exposed\b", r"\bwere exposed\b",
            r"\bin the path\b", r"\bin the line of fire\b", r"\bstanding\b.*\bnear\b", r"\bworking\b.*\bnear\b",
        ]),
        "body_part_contact": ("Direct contact with body part", [
            r"\bhand\b.*\bcontact\b", r"\bhis hand\b", r"\bher hand\b", r"\bface\b", r"\beye\b", r"\barm\b", r"\bleg\b",
            r"\bhead\b", r"\bfoot\b", r"\bfinger\b",
        ]),
        "line_of_fire": ("Line-of-fire exposure", [
            r"\bline of fire\b", r"\bin the path\b", r"\bdirection of (the )?flow\b", r"\bstruck by\b",
            r"\bprojected\b", r"\bprojection\b",
        ]),
        "fall_exposure": ("Fall exposure", [
            r"\bworking at\b.*\bheight\b", r"\bheight of\b", r"\bnear\b.*\bopening\b", r"\badjacent to\b.*\bopening\b",
            r"\bclimbs?\b.*\bheight\b", r"\bfalls?\b", r"\bfell\b",
        ]),
        "mobile_equipment_exposure": ("Pedestrian / mobile-equipment interaction", [
            r"\bon foot\b", r"\bcross(ed|ing)? the roadway\b", r"\bloader\b.*\bpassed\b", r"\bvehicle\b.*\bworker\b",
            r"\bnear\b.*\btruck\b",
        ]),
    },
    "consequences": {
        "fatality": ("Fatality", [r"\bfatal(ity)?\b", r"\bdeath\b", r"\bdied\b", r"\bdead\b"]),
        "serious_injury": ("Serious / life-altering injury", [
            r"\bserious injury\b", r"\bsevere injury\b", r"\blife[\s-]?altering\b", r"\btraumatic injury\b",
            r"\bfracture(d|s)?\b", r"\bamputation\b", r"\bcrushing\b",
        ]),
        "burn_thermal_injury": ("Burn / thermal injury", [r"\bburn(ed|s)?\b", r"\bscald(ed|ing)?\b", r"\bthermal injury\b"]),
        "electrical_injury": ("Electrical injury", [
            r"\belectric shock\b", r"\belectrocution\b", r"\bcardiac arrest\b", r"\barc[\s-]?flash\b",
        ]),
        "crush_amputation": ("Crushing / amputation", [
            r"\bcrush(ing|ed)?\b", r"\bamputation\b", r"\btraumatic amputation\b", r"\brun[\s-]?over\b",
        ]),
        "struck_by": ("Struck-by injury", [
            r"\bstruck by\b", r"\bhit\b", r"\bimpact(ed)?\b", r"\bfalling rock\b", r"\bproject(ed|ile)\b",
        ]),
        "minor_injury": ("Minor injury", [
            r"\bminor\b", r"\bsmall burn\b", r"\bcut\b", r"\bscratch\b", r"\bswelling\b", r"\brash\b", r"\birritation\b",
        ]),
    },
    "barriers": {
        "isolation_loto": ("Isolation / lockout-tagout", [
            r"\blockout\b", r"\btagout\b", r"\bLOTO\b", r"\bisolation\b", r"\bde-energiz(ed|ation)\b",
            r"\bdeenergiz(ed|ation)\b",
        ]),
        "guarding": ("Machine guarding", [r"\bguard(ing|ed)?\b", r"\bmachine protection\b", r"\bprotective guard\b"]),
        "fall_protection": ("Fall prevention / fall protection", [
            r"\bfall protection\b", r"\bfall prevention\b", r"\bguardrail\b", r"\bhandrail\b", r"\bsafety harness\b",
            r"\blifeline\b",
        ]),
        "exclusion_barricade": ("Exclusion / barricading", [
            r"\bbarricad(e|ed|ing)\b", r"\bexclusion zone\b", r"\bmarked with tape\b", r"\bcones\b",
            r"\bcontrolled access\b",
        ]),
        "pressure_isolation": ("Pressure isolation / depressurization", [
            r"\bdepressuriz(e|ation|ed)\b", r"\bdepressurise\b", r"\bpressure verification\b", r"\bbleed(ing)?\b",
            r"\bdrain(ing)?\b", r"\bpositive isolation\b",
        ]),
        "ground_control": ("Ground control / scaling", [
            r"\bground control\b", r"\bground-control\b", r"\bscaling\b", r"\bground support\b", r"\broof support\b",
        ]),
        "electrical_protection": ("Electrical protection", [
            r"\babsence-of-voltage\b", r"\babsence of voltage\b", r"\barc[\s-]?flash PPE\b",
            r"\belectrical isolation\b", r"\bprotection system\b", r"\bPPE\b",
        ]),
        "work_procedure": ("Procedure / work control", [
            r"\bprocedure\b", r"\bpermit\b", r"\bJSA\b", r"\bjob safety analysis\b", r"\bwork permit\b",
        ]),
    },
    "activities": {
        "loading_drilling": ("Drilling / loading", [
            r"\bloading drills\b", r"\bdrill(ing)?\b", r"\bloader\b", r"\bproduction drills\b",
        ]),
        "shotcrete": ("Shotcrete", [r"\bshotcrete\b", r"\bshotcrete casting\b", r"\bshotcrete launch\b"]),
        "painting": ("Painting", [r"\bpaint(ing|ed)?\b", r"\bpainting\b"]),
        "washing_cleaning": ("Washing / cleaning", [r"\bwash(ing|ed)?\b", r"\bclean(ing|ed)?\b", r"\bcleaning\b"]),
        "assembly_installation": ("Assembly / installation", [
            r"\bassembl(y|ing)\b", r"\binstall(ation|ing)\b", r"\bassembling\b",
        ]),
        "inspection": ("Inspection", [r"\binspect(ion|ing|ed)\b", r"\binspection\b"]),
    },
}

# Wording of high confidence, and the keys behind the summary counts.
STRONG = [
    "arc flash", "electric shock", "electrocution", "line of fire", "struck by", "fatality", "death", "lockout", "tagout",
    "positive isolation", "ground control", "fall protection", "vertical opening", "suspended load", "ground fall",
]
HIGH_RISK = [
    "electrical_energy", "mechanical_energy", "pressure_process_energy", "thermal_energy", "gravity_fall_energy",
    "ground_rock_energy", "mobile_equipment_energy", "suspended_load", "fire_explosion",
]
DIRECT = ["direct_worker_exposure", "line_of_fire", "fall_exposure", "mobile_equipment_exposure"]
SEVERE = ["fatality", "serious_injury", "burn_thermal_injury", "electrical_injury", "crush_amputation", "struck_by"]
