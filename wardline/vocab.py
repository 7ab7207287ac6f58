"""Keyword lists, label lists, thresholds and texts.

These must stay exactly as they are, because results are defined by them.
Everything is plain data; the expressions that use it live in ``functions``.
"""

from __future__ import annotations

# --- fixed values: log schema -------------------------------------------------

LOG_COLUMNS = ["created_at", "issue_type", "severity", "urgency", "location", "complaint_text"]

RAW_COLUMNS = ["Category", "Sub Category", "Ward Name", "Staff Remarks"]

# --- fixed values: severity keywords (whole words) ------------------------------

SEVERITY_HIGH = [
    "danger", "hazard", "electrocution", "electrical", "fire", "explosion", "blast", "accident",
    "collapse", "short circuit", "shock", "gas leak", "life threatening", "major fault",
    "major damage", "very dangerous", "transformer",
]
SEVERITY_MEDIUM = [
    "not working", "no supply", "garbage", "waste", "drain", "block", "clog", "leak", "overflow",
    "damage", "pothole", "pot hole", "street light", "streetlight", "repair", "road damage",
]
SEVERITY_LOW = [
    "clean", "sweeping", "maintenance", "request", "follow up", "general cleaning", "cleaning",
    "minor", "routine", "grass", "fogging", "debris", "small issue", "low priority",
    "regular cleaning",
]

# Power and lighting faults: one of the first list with one of the second (substrings).
POWER_TERMS = ["electric", "street light", "streetlight"]
POWER_FAULTS = ["not working", "failure", "shock"]

# --- fixed values: urgency keywords (substrings) --------------------------------

URGENCY_URGENT = [
    "urgent", "emergency", "immediate", "asap", "critical", "crisis", "dangerous",
    "life threatening", "life-threatening", "hazardous", "severe accident", "serious accident",
    "major accident", "injury", "injured", "death", "fatal", "died", "dying", "collapsed",
    "collapse", "burst", "explosion", "fire", "flooding", "electrical shock", "electrocution",
    "gas leak", "toxic", "cannot wait", "right now", "immediately", "must fix now",
    "children at risk", "elderly at risk", "lives at stake", "health hazard", "public danger",
    "safety threat", "broken water main", "sewage overflow", "major damage", "road blocked",
    "traffic accident", "multiple casualties", "unacceptable", "outrageous", "disgraceful",
    "appalling", "!!!",
]
URGENCY_CONCERNED = [
    "concerned", "worried", "unsafe", "risky", "hazard", "attention needed", "should fix",
    "needs repair", "needs attention", "deteriorating", "worsening", "spreading", "growing worse",
    "leaking", "cracked", "damaged", "broken", "malfunctioning", "overflowing", "blocked",
    "clogged", "not working", "health concern", "safety concern", "potential danger", "repeated",
    "multiple times", "still not fixed", "ignored", "for weeks", "for days", "long time",
    "several days", "getting worse", "becoming dangerous", "risk of", "please fix", "need help",
    "require attention", "serious", "significant", "major", "severe",
]

# --- fixed values: civic categories and their keywords (substrings) --------------

GENERAL = "General Complaint"

CATEGORY_KEYWORDS = {
    "Street Lighting Fault": ["street light", "lamp", "lighting", "dark stretch", "pole"],
    "Electrical Hazard": ["electric", "wire", "transformer", "power line", "spark"],
    "Water Supply Disruption": ["water", "pipeline", "tap", "supply", "tank", "leakage"],
    "Waste & Sanitation": ["garbage", "trash", "waste", "dump", "sanitation", "sewage"],
    "Road & Pothole Hazard": ["pothole", "road", "asphalt", "lane", "traffic", "accident"],
    "Drainage / Flooding": ["drain", "flood", "storm water", "clogged", "overflow"],
    "Infrastructure Damage": ["crack", "collapse", "retaining wall", "bridge", "structure", "damage"],
    "Public Safety Concern": ["safety", "hazard", "injury", "danger", "risk"],
}

NO_KEYWORD_RATIONALE = "No strong domain keywords; preserving model output"
MODEL_RATIONALE = "Classifier selected civic category '{}'."
KEYWORD_RATIONALE = "Matched keywords: "
KEYWORD_OVERRIDE_BELOW = 0.68

MODEL_LABEL_CATEGORY = {
    "LABEL_6": "Street Lighting Fault",
    "LABEL_16": "Electrical Hazard",
    "LABEL_21": "Structural Safety Risk",
    "LABEL_28": "Water Supply Disruption",
}

# --- fixed values: labels of the three model heads ------------------------------

CATEGORY_LABELS = [
    "Advertisement", "BBMP Election Branch", "CORONA COVID19", "Call Center",
    "E khata / Khata services", "Education", "Electrical", "Estate", "Forest", "Health Dept",
    "Indira Canteen", "Information Technology", "Lakes", "Markets", "Optical Fiber Cables (OFC)",
    "Others", "Parks and Play grounds", "Plastic", "Projects Central", "Property Tax services",
    "Revenue Department", "Road Infrastructure", "Road Maintenance(Engg)", "Sanitation",
    "Solid Waste (Garbage) Related", "Storm  Water Drain(SWD)", "Town Planning",
    "Traffic Engineer Cell (TEC)", "Water Crisis", "Welfare Schemes", "veterinary",
]
SEVERITY_LABELS = ["Low", "Medium", "High"]
URGENCY_LABELS = ["Neutral", "Concerned", "Angry/Urgent"]
STUB_CATEGORY_LABELS = [
    "Road Issue", "Water Supply", "Electricity", "Garbage", "Public Safety", "General Complaint",
]

# --- fixed values: least confidence a keyword hint enforces ----------------------

SEVERITY_HINT_MINIMUM = {
    "live": {"High": 0.85, "Medium": 0.65, "Low": 0.75},
    "stub": {"High": 0.75, "Medium": 0.6, "Low": 0.75},
}
URGENCY_HINT_MINIMUM = {"Angry/Urgent": 0.80, "Concerned": 0.70}

# --- fixed values: answers when a head gave no scores ----------------------------

SEVERITY_FALLBACK = [("Low", 0.33), ("Medium", 0.34), ("High", 0.33)]
URGENCY_FALLBACK = [("Neutral", 0.34), ("Concerned", 0.33), ("Angry/Urgent", 0.33)]
FALLBACK_CONFIDENCE = 0.33
FALLBACK_HINT_CONFIDENCE = 0.5

# --- fixed values: weak labelling of raw grievances (whole words) -----------------

WEAK_HIGH = [
    "danger", "hazard", "electrocution", "electrical", "fire", "explosion", "blast", "accident",
    "collapse", "short circuit", "shock", "safety", "gas leak", "life threatening", "major fault",
    "major damage", "very dangerous", "transformer",
]
WEAK_MEDIUM = SEVERITY_MEDIUM
WEAK_LOW = SEVERITY_LOW
WEAK_URGENT = [
    "immediate", "urgent", "danger", "hazard", "outage", "shutdown", "fire", "explosion",
    "accident", "collapse", "electrical", "life threatening", "very dangerous", "needs quick fix",
]
WEAK_CONCERNED = [
    "not working", "no supply", "garbage", "drain", "block", "clog", "leak", "overflow", "repair",
    "delay", "issue",
]
WEAK_NEUTRAL = [
    "assigned", "registered", "mapping", "forwarded", "acknowledged", "noted", "ward mapping",
]

# --- fixed values: recommendations ------------------------------------------------

REC_ESCALATE = "Escalate to the rapid response team and notify field operations immediately."
REC_DISPATCH = "Prioritise dispatch within 2 hours and issue a citizen acknowledgment SMS."
REC_ROAD = "Coordinate with traffic management for temporary safety barricades."
REC_QUEUE = "Queue for scheduled maintenance after verifying resource availability."

# --- fixed values: features and entities -------------------------------------------

FEATURE_KEYWORDS = ["critical", "severe", "danger", "major", "collapse"]
MAX_FEATURES = 4000
LOCATION_LABELS = ["LOC", "GPE", "LOCATION"]

# --- our own choices ----------------------------------------------------------------

# Seed gazetteer: places and problems seen in complaints; callers may pass their own.
PLACES = [
    "jayanagar", "indiranagar", "rajajinagar", "vijayanagar", "koramangala", "malleshwaram",
    "hampinagar", "attiguppe", "shivajinagar", "kengeri", "uttarahalli", "gandhi nagar",
    "rpc layout", "bms college circle", "maruthi mandir road", "jayanagar 4th block",
]
PROBLEMS = [
    "pothole", "street light", "garbage heap", "gas leak", "short circuit", "transformer",
    "sewage overflow", "water supply", "debris", "drain", "main road", "wall", "road",
]

STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "had", "has", "have",
    "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
]
