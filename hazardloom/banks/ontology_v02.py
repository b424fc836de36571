"""Ontology of the sentence extractor v0.2: family -> key -> (label, patterns, priority)."""

# Patterns per key, tried in this order within a sentence.
ONTOLOGY = {
    "hazards": {
        "electrical_energy": ("Electrical energy", [
            r"\b440\s*v\b", r"\b\d+\s*v\b.*\b(panel|board|equipment|installation)\b", r"\belectric(al)? board\b",
            r"\belectr(ical|ic)\s+equipment\b", r"\benerg(ized|ise|ize|izing)\b", r"\barc[\s-]?flash\b",
            r"\bphase[\s-]+to[\s-]+ground\b", r"\belectric shock\b", r"\belectrocution\b", r"\bpower cord\b",
            r"\bhigh voltage\b", r"\bthermomagnetic\b",
        ], 5),
        "mechanical_energy": ("Mechanical / moving equipment energy", [
            r"\brotat(ing|ion)\b", r"\bmoving (equipment|machine|part)\b", r"\bmachine\b", r"\bmechanical\b", r"\bfan\b",
            r"\bpropeller\b", r"\bblade\b", r"\bcutter blade\b", r"\bcrush(ing|ed)?\b", r"\bpinch(ed|ing)?\b",
            r"\bentangle(d|ment)?\b", r"\brun[\s-]?over\b",
        ], 4),
        "pressure_process_energy": ("Pressure / process energy", [
            r"\bpressurized\b", r"\bpressurised\b", r"\bpressure\b", r"\bstored pressure\b", r"\bstored energy\b",
            r"\brupture(d)?\b", r"\brelease(d)?\b", r"\bflange\b", r"\bpiping\b", r"\bpipe\b", r"\bprocess line\b",
        ], 3),
        "thermal_energy": ("Thermal / hot material", [
            r"\bhot gas\b", r"\bhot pulp\b", r"\bhot material\b", r"\bthermal\b", r"\bheated\b", r"\bheat\b",
            r"\bburn(ed|s)?\b", r"\bscald(ing|ed)?\b", r"\bfurnace\b", r"\bmolten\b",
        ], 5),
        "gravity_fall_energy": ("Gravity / fall-from-height energy", [
            r"\bfall from height\b", r"\bfalling from\b", r"\bfalls?\s+\w+\s+meters?\b", r"\bfell\b", r"\bfalls?\b",
            r"\bheight of \d+\s*(m|meters?)\b", r"\bat an approximate height\b", r"\bvertical opening\b",
            r"\bchimney\b", r"\bopening\b",
        ], 4),
        "ground_rock_energy": ("Ground / rockfall energy", [
            r"\bfalling rock\b", r"\brockfall\b", r"\brock block\b", r"\bstone slab\b", r"\bslab\b.*\bdetached\b",
            r"\bunstable (ground|roof|rock)\b", r"\bground movement\b", r"\bground fall\b",
            r"\broof\b.*\bdetach(ed|ment)\b", r"\brock\b.*\bdetach(ed|ment)\b",
        ], 5),
        "mobile_equipment_energy": ("Mobile equipment / vehicle movement", [
            r"\bwheel[\s-]?loader\b", r"\bloader\b", r"\btruck\b", r"\bvehicle\b", r"\bmobile equipment\b", r"\btire\b",
            r"\broadway\b", r"\bcross(ed|ing)?\b.*\broad\b", r"\bpassed\b.*\bworker\b",
        ], 4),
        "chemical_exposure": ("Chemical substance / exposure", [
            r"\bpaint\b", r"\bsolvent\b", r"\bchemical\b", r"\btoxic\b", r"\bcorrosive\b", r"\bchemical substance\b",
        ], 3),
        "suspended_load": ("Suspended / falling load", [
            r"\bsuspended load\b", r"\bfalling load\b", r"\blift(ed|ing)?\b.*\bload\b", r"\bcrane\b",
            r"\bhook\b.*\bload\b", r"\bpump\b.*\bfall(s|en|ing)?\b", r"\bobject\b.*\bfell\b",
        ], 3),
        "fire_explosion": ("Fire / explosion energy", [
            r"\bfire\b", r"\bflame\b", r"\bexplosion\b", r"\bexplosive\b", r"\bignit(e|ion|ed|ing)\b", r"\bflash\b",
        ], 4),
        "biological_hazard": ("Biological / animal hazard", [
            r"\bbee(s)?\b", r"\bsting\b", r"\bstung\b", r"\bbite(s)?\b", r"\bvenomous\b", r"\bsnake\b",
        ], 3),
    },
    "exposures": {
        "direct_contact": ("Direct bodily contact / exposure", [
            r"\b(operator|employee|worker|collaborator)\b.*\bcausing\b.*\b(injury|burn|cut)\b",
            r"\b(worker|employee|operator)\b.*\bwas exposed\b", r"\bdirectly exposed\b", r"\bexposed to\b",
            r"\breached\b.*\boperator\b", r"\breaches?\b.*\bworker\b",
        ], 5),
        "body_part_exposure": ("Body part exposed / contacted", [
            r"\b(hit|struck|touch(es|ed)?|graz(e|ed|ing)|rub(s|bed|bing))\b.*\b(hand|arm|leg|face|eye|head|finger|foot)\b",
            r"\b(hand|arm|leg|face|eye|head|finger|foot)\b.*\b(hit|struck|burn|cut|contact|rubbed|grazed)\b",
            r"\bcausing (?:a|an)\s+(?:cut|burn|injury)\b", r"\breaches?\b.*\bface\b",
        ], 5),
        "line_of_fire": ("Line-of-fire exposure", [
            r"\bline of fire\b", r"\bin the path\b", r"\bin the direction of\b", r"\bstruck by\b", r"\bprojected\b",
            r"\bprojection\b", r"\bbetween\b.*\b(equipment|machine|vehicle)\b.*\band\b",
        ], 5),
        "fall_exposure": ("Fall exposure", [
            r"\bworking\b.*\b(at|from)\b.*\bheight\b", r"\bheight of \d+\s*(m|meters?)\b",
            r"\bclimbs?\b.*\b(\d+|height)\b", r"\badjacent to\b.*\b(opening|chimney)\b",
            r"\bnear\b.*\b(opening|chimney)\b", r"\bfalls?\b", r"\bfell\b",
        ], 4),
        "mobile_equipment_exposure": ("Pedestrian / mobile-equipment interaction", [
            r"\bon foot\b", r"\bcross(ed|ing)?\b.*\broad\b", r"\bloader\b.*\bworker\b", r"\bvehicle\b.*\bworker\b",
            r"\bnear\b.*\btruck\b", r"\bbetween\b.*\b(equipment|machine|vehicle)\b",
        ], 4),
        "material_exposure": ("Material / substance exposure", [
            r"\breached?\b.*\b(face|eye|skin)\b", r"\bpaint\b.*\bface\b", r"\bhot gas\b.*\bface\b",
            r"\bhot pulp\b.*\b(employee|worker|operator)\b", r"\bcontact\b.*\b(chemical|paint|gas)\b",
        ], 3),
    },
    "consequences": {
        "fatality": ("Fatality", [
            r"\bfatality\b", r"\bfatal\b", r"\bdeath\b", r"\bdied\b", r"\bdead\b", r"\bpassed away\b",
        ], 6),
        "serious_injury": ("Serious / potentially serious injury", [
            r"\bserious injury\b", r"\bsevere injury\b", r"\blife[\s-]?altering\b", r"\btraumatic injury\b",
            r"\bmajor injury\b", r"\bfracture(d|s)?\b", r"\bamputation\b", r"\bcrushing\b", r"\btrapped\b",
            r"\bimprisoned\b",
        ], 5),
        "electrical_injury": ("Electrical injury", [
            r"\belectric shock\b", r"\belectrocution\b", r"\barc[\s-]?flash\b.*\b(injury|reach|operator)\b",
            r"\bflash\b.*\breach(es|ed)?\b.*\boperator\b",
        ], 5),
        "thermal_injury": ("Burn / thermal injury", [
            r"\bburn(ed|s)?\b", r"\bscald(ed|ing)?\b", r"\bthermal injury\b", r"\bhot gas\b.*\b(injury|face|employee)\b",
        ], 4),
        "struck_by": ("Struck-by injury", [
            r"\bstruck by\b", r"\bhit\b", r"\bimpacted?\b", r"\bimpact(s|ed)?\b.*\b(arm|leg|head|worker)\b",
            r"\bgrazing\b", r"\bgrazed\b", r"\bblade\b.*\b(cut|injur)\b",
        ], 4),
        "crush_amputation": ("Crushing / amputation", [
            r"\bcrush(ing|ed)?\b", r"\bamputation\b", r"\btrapped\b", r"\bimprisoned\b", r"\b(run[\s-]?over|run over)\b",
        ], 5),
        "cut_laceration": ("Cut / laceration", [
            r"\bcut(s)?\b", r"\blacerat(ed|ion)\b", r"\bblunt cut\b", r"\bsmall cuts?\b", r"\bcut of\b",
        ], 3),
        "minor_injury": ("Minor injury / irritation", [
            r"\blittle trauma\b", r"\bminor\b", r"\bscratch\b", r"\bswelling\b", r"\birritation\b", r"\brash\b",
        ], 2),
    },
    "barriers": {
        "isolation_loto": ("Isolation / lockout-tagout", [
            r"\blockout\b", r"\btagout\b", r"\bLOTO\b", r"\block\b.*\bremoved\b", r"\bisolation\b",
            r"\bde-energiz(ed|ation|e|ing)\b",
        ], 5),
        "guarding": ("Machine guarding", [r"\bguard(ing|ed)?\b", r"\bmachine protection\b", r"\bprotective guard\b"], 4),
        "fall_protection": ("Fall prevention / protection", [
            r"\bfall protection\b", r"\bfall prevention\b", r"\bguardrail\b", r"\bhandrail\b", r"\bsafety harness\b",
            r"\blifeline\b",
        ], 5),
        "exclusion_control": ("Exclusion / barricading / separation", [
            r"\bbarricad(e|ed|ing)\b", r"\bexclusion zone\b", r"\bmarked with tape\b", r"\bcones\b",
            r"\bcontrolled access\b", r"\bseparation\b",
        ], 4),
        "pressure_isolation": ("Pressure isolation / depressurization", [
            r"\bdepressuriz(e|ation|ed)\b", r"\bdepressurise\b", r"\bpressure verification\b", r"\bbleed(ing)?\b",
            r"\bdrain(ing)?\b", r"\bpositive isolation\b",
        ], 5),
        "ground_control": ("Ground control / scaling", [
            r"\bground control\b", r"\bground-control\b", r"\bscaling\b", r"\bground support\b", r"\broof support\b",
        ], 5),
        "electrical_protection": ("Electrical protection", [
            r"\babsence[- ]of[- ]voltage\b", r"\babsence of voltage\b", r"\barc[\s-]?flash PPE\b",
            r"\belectrical isolation\b", r"\bprotection system\b", r"\bprotective equipment\b", r"\bgloves?\b", r"\bPPE\b",
        ], 3),
        "procedure_work_control": ("Procedure / work control", [
            r"\bprocedure\b", r"\bpermit\b", r"\bJSA\b", r"\bjob safety analysis\b", r"\bwork permit\b",
        ], 2),
    },
    "activities": {
        "drilling": ("Drilling", [r"\bdrill(ing)?\b", r"\bloading drills\b", r"\bproduction drills\b", r"\bdrill holes\b"], 5),
        "shotcrete": ("Shotcrete", [r"\bshotcrete\b", r"\bshotcrete casting\b", r"\bshotcrete launch\b"], 5),
        "painting": ("Painting", [r"\bpaint(ing|ed)?\b", r"\bpainting\b"], 4),
        "washing_cleaning": ("Washing / cleaning", [r"\bwash(ing|ed)?\b", r"\bclean(ing|ed)?\b", r"\bcleaning\b"], 4),
        "assembly_installation": ("Assembly / installation", [
            r"\bassembl(y|ing)\b", r"\binstall(ation|ing)\b", r"\binstallation\b",
        ], 3),
        "inspection": ("Inspection", [r"\binspect(ion|ing|ed)\b", r"\binspection\b"], 3),
        "adjustment_tightening": ("Adjustment / tightening", [
            r"\badjustment\b", r"\btighten(ing)?\b", r"\bloos(en|ing)\b",
        ], 3),
    },
}

# Wording, priorities and word counts that make high and medium confidence.
STRONG = [
    "440 v", "arc flash", "electric shock", "lock removed", "ground control", "fall protection", "line of fire", "fatal",
    "death", "imprisoned", "struck by",
]
HIGH_PRIORITY, HIGH_WORDS, MEDIUM_PRIORITY = 5, 3, 3
