"""Small dimension tables. Joined with ``F.broadcast`` — each has a fixed, tiny row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's values for results to agree.
# ---------------------------------------------------------------------------------------------

# Corridor → tier (21 rows). "Bannerghatta Road" is spelled this way in the map only.
CORRIDOR_TIERS = {
    "Mysore Road": 1, "Bellary Road 1": 1, "Tumkur Road": 1,
    "Bellary Road 2": 1, "Hosur Road": 1,
    "ORR North 1": 2, "Old Madras Road": 2, "Magadi Road": 2,
    "ORR East 1": 2, "ORR North 2": 2, "Bannerghatta Road": 2,
    "ORR East 2": 2, "West of Chord Road": 2,
    "ORR West 1": 3, "ORR South 1": 3, "Kanakapura Road": 3,
    "Sarjapur Road": 3, "Hennur Road": 3, "Airport New South Road": 3,
    "ORR West 2": 3, "ORR South 2": 3,
}

EVENT_CAUSES = [
    "vehicle_breakdown", "accident", "tree_fall", "water_logging",
    "construction", "pot_holes", "road_conditions", "public_event",
    "procession", "vip_movement", "protest", "congestion", "others", "Debris",
]

# Vehicle display name → key.
VEH_DISPLAY_MAP = {
    "BMTC Bus": "bmtc_bus", "Heavy Vehicle": "heavy_vehicle",
    "LCV": "lcv", "Others": "others", "Private Bus": "private_bus",
    "Private Car": "private_car", "KSRTC Bus": "ksrtc_bus",
    "Taxi": "taxi", "Auto": "auto", "Truck": "truck",
}

# Cause severity points: baseline (default 5), trial 2 (default 6), method 5 (default 7), method 6 (default 5).
CAUSE_SEVERITY = {
    "protest": 25, "water_logging": 20, "tree_fall": 18, "accident": 15,
    "public_event": 12, "procession": 10, "vip_movement": 10,
    "construction": 8, "road_conditions": 8, "pot_holes": 5,
    "congestion": 5, "vehicle_breakdown": 3, "Debris": 5, "others": 5,
}
CAUSE_SEVERITY_T2 = {
    "protest": 28, "water_logging": 22, "tree_fall": 20, "accident": 18,
    "public_event": 14, "procession": 12, "vip_movement": 12,
    "construction": 10, "road_conditions": 9, "pot_holes": 6,
    "congestion": 7, "vehicle_breakdown": 5, "Debris": 6, "others": 6,
}
CAUSE_SEVERITY_M5 = {
    "protest": 30, "water_logging": 24, "tree_fall": 22, "accident": 20,
    "public_event": 15, "procession": 13, "vip_movement": 13,
    "construction": 11, "road_conditions": 10, "pot_holes": 7,
    "congestion": 8, "vehicle_breakdown": 6, "Debris": 7, "others": 7,
}
CAUSE_SEVERITY_M6 = {
    "protest": 25, "water_logging": 20, "tree_fall": 18, "accident": 16,
    "public_event": 12, "procession": 10, "vip_movement": 10,
    "construction": 8, "road_conditions": 8, "pot_holes": 5,
    "congestion": 6, "vehicle_breakdown": 4, "Debris": 5, "others": 5,
}
SEVERITY_MAPS = {"base": (CAUSE_SEVERITY, 5), "t2": (CAUSE_SEVERITY_T2, 6),
                 "m5": (CAUSE_SEVERITY_M5, 7), "m6": (CAUSE_SEVERITY_M6, 5)}

# Cause clusters (method 4): 3 high, 2 medium, everything else 1.
HIGH_SEVERITY_CAUSES = ["protest", "water_logging", "tree_fall", "accident"]
MEDIUM_SEVERITY_CAUSES = ["public_event", "procession", "vip_movement", "construction", "road_conditions"]

# Cause contribution of the prediction breakdown (default 20).
BREAKDOWN_CAUSE_POINTS = {
    "tree_fall": 38, "water_logging": 35, "protest": 32,
    "fire": 30, "veh_breakdown": 22, "accident": 28,
    "road_damage": 25, "crane_operations": 20, "others": 15,
}

# Traffic intensity by hour and weight by weekday (Mon=0).
HOUR_INTENSITY = {0: 0.2, 1: 0.1, 2: 0.1, 3: 0.1, 4: 0.2, 5: 0.4, 6: 0.6,
                  7: 0.9, 8: 1.0, 9: 0.9, 10: 0.7, 11: 0.7, 12: 0.6,
                  13: 0.6, 14: 0.7, 15: 0.7, 16: 0.8, 17: 0.95, 18: 1.0,
                  19: 0.9, 20: 0.7, 21: 0.5, 22: 0.3, 23: 0.2}
WEEKDAY_WEIGHT = {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.6, 6: 0.5}

# Operational baseline tier points.
BASELINE_TIER_POINTS = {1: 30, 2: 20, 3: 10, 0: 0}

# Resource scaling multipliers.
RISK_MULTIPLIER = {"Critical": 2.0, "High": 1.5, "Medium": 1.0, "Low": 0.7}
TIER_MULTIPLIER = {0: 1.0, 1: 1.5, 2: 1.25, 3: 1.1}

# Resource template per cause (fallback "others"): response timeline, resolution (median, range), base resources.
RESOURCE_TEMPLATES = {
    "tree_fall": {
        "timeline": [("0-15 min", ["Police Units", "Area Barricading"]), ("15-30 min", ["BBMP Tree Crew"]),
                     ("30-60 min", ["Barricades", "Traffic Diversion"])],
        "resolution": ("1.2h", "0.4h–4.0h"),
        "resources": {"police": 2, "barricades": 4, "crew": "BBMP Tree Crew", "tow": 0, "diversion": True}},
    "vehicle_breakdown": {
        "timeline": [("0-15 min", ["Police Unit"]), ("15-30 min", ["Tow Truck"])],
        "resolution": ("0.5h", "0.5h–1.0h"),
        "resources": {"police": 1, "barricades": 0, "crew": "None", "tow": 1, "diversion": False}},
    "accident": {
        "timeline": [("0-15 min", ["Police Units (2)", "Ambulance"]), ("15-30 min", ["Tow Truck", "Barricades"]),
                     ("30-60 min", ["Investigation Team", "Traffic Diversion"])],
        "resolution": ("2.0h", "1.0h–3.0h"),
        "resources": {"police": 2, "barricades": 2, "crew": "Accident Investigation", "tow": 1, "diversion": True}},
    "water_logging": {
        "timeline": [("0-15 min", ["Police Unit", "Barricading"]), ("15-60 min", ["BWSSB Drainage Team"]),
                     ("Ongoing", ["Traffic Diversion"])],
        "resolution": ("3.0h", "2.0h–8.0h"),
        "resources": {"police": 1, "barricades": 2, "crew": "BWSSB Drainage Team", "tow": 0, "diversion": True}},
    "construction": {
        "timeline": [("0-15 min", ["Police Unit", "Barricading"]), ("Ongoing", ["BBMP Oversight", "Traffic Diversion"])],
        "resolution": ("12.0h", "4.0h–48.0h"),
        "resources": {"police": 1, "barricades": 5, "crew": "BBMP Oversight", "tow": 0, "diversion": True}},
    "pot_holes": {
        "timeline": [("0-15 min", ["Barricading"]), ("15-60 min", ["BBMP Road Crew"])],
        "resolution": ("2.0h", "1.0h–4.0h"),
        "resources": {"police": 0, "barricades": 2, "crew": "BBMP Road Crew", "tow": 0, "diversion": False}},
    "public_event": {
        "timeline": [("Pre-event", ["Police Units (4)", "Barricading (8)"]), ("During", ["Traffic Diversion", "Crowd Control"])],
        "resolution": ("6.0h", "4.0h–12.0h"),
        "resources": {"police": 4, "barricades": 8, "crew": "Event Management", "tow": 0, "diversion": True}},
    "procession": {
        "timeline": [("Pre-event", ["Police Units (3)", "Route Barricading"]), ("During", ["Escort", "Traffic Diversion"])],
        "resolution": ("3.0h", "2.0h–6.0h"),
        "resources": {"police": 3, "barricades": 5, "crew": "None", "tow": 0, "diversion": True}},
    "vip_movement": {
        "timeline": [("Pre-event", ["Police Units (5)", "Route Clearance"]), ("During", ["Escort", "Full Diversion"])],
        "resolution": ("2.0h", "1.0h–4.0h"),
        "resources": {"police": 5, "barricades": 8, "crew": "None", "tow": 0, "diversion": True}},
    "protest": {
        "timeline": [("0-15 min", ["Police Units (6)", "Barricading"]), ("During", ["Crowd Control", "Full Diversion"])],
        "resolution": ("5.0h", "2.0h–12.0h"),
        "resources": {"police": 6, "barricades": 8, "crew": "None", "tow": 0, "diversion": True}},
    "road_conditions": {
        "timeline": [("0-15 min", ["Police Unit", "Barricading"]), ("15-60 min", ["BBMP Road Crew"])],
        "resolution": ("3.0h", "2.0h–8.0h"),
        "resources": {"police": 1, "barricades": 2, "crew": "BBMP Road Crew", "tow": 0, "diversion": False}},
    "congestion": {
        "timeline": [("0-15 min", ["Police Unit"]), ("15-30 min", ["Signal Override / Manual Control"])],
        "resolution": ("1.5h", "1.0h–3.0h"),
        "resources": {"police": 1, "barricades": 0, "crew": "None", "tow": 0, "diversion": False}},
    "Debris": {
        "timeline": [("0-15 min", ["Police Unit", "Barricading"]), ("15-30 min", ["BBMP Cleanup Crew"])],
        "resolution": ("1.0h", "0.5h–2.0h"),
        "resources": {"police": 1, "barricades": 2, "crew": "BBMP Cleanup Crew", "tow": 0, "diversion": False}},
    "others": {
        "timeline": [("0-15 min", ["Police Unit"]), ("15-30 min", ["Assessment & Dispatch"])],
        "resolution": ("2.0h", "1.0h–4.0h"),
        "resources": {"police": 1, "barricades": 1, "crew": "Standard", "tow": 0, "diversion": False}},
}

# Proactive plan per class: actions in order, and timeline steps (time, action, resources).
PLAN_ACTIONS = {
    "Critical": ["Deploy traffic personnel 2 hours before event", "Set up barricades at key junctions 1 hour before",
                 "Activate traffic diversion plan", "Coordinate with event organizers for crowd management",
                 "Alert nearby hospitals and emergency services"],
    "High": ["Deploy traffic personnel 1 hour before event", "Pre-position tow trucks if needed",
             "Monitor traffic flow in real-time", "Coordinate with event organizers"],
    "Medium": ["Monitor event remotely", "Keep rapid response team on standby", "Pre-plan diversion routes"],
    "Low": ["Standard monitoring"],
}
PLAN_TIMELINE = {
    "Critical": [("T-2 hours", "Deploy 8-10 traffic officers to corridor", {"officers": 10, "barricades": 20}),
                 ("T-1 hour", "Set up full barricading and signage", {"barricades": 20, "signage": 15}),
                 ("Event start", "Monitor and adjust traffic flow", {"officers": 10, "patrol_vehicles": 3})],
    "High": [("T-1 hour", "Deploy 5-6 traffic officers", {"officers": 6, "barricades": 10}),
             ("Event start", "Active traffic management", {"officers": 6, "patrol_vehicles": 2})],
    "Medium": [("Event start", "Monitor from command center", {"officers": 2, "standby_team": 4})],
    "Low": [("Event time", "Routine patrol", {"officers": 1})],
}
PLAN_RESOURCES = ["officers", "barricades", "signage", "patrol_vehicles", "standby_team"]

# Vehicle notes.
VEH_NOTES = {
    "bmtc_bus": "Coordinate BMTC depot for replacement bus",
    "ksrtc_bus": "Coordinate KSRTC depot for replacement bus",
    "heavy_vehicle": "Heavy-duty crane/tow required",
    "truck": "Heavy-duty crane + cargo transfer vehicle",
    "private_bus": "Large tow truck + passenger transfer",
}

# Planned event type code (default 4).
EVENT_TYPE_ENCODING = {"festival": 0, "sports": 1, "rally": 2, "procession": 3,
                       "public_event": 4, "construction": 5}

# Corridor centroids (lat, lon).
CORRIDOR_CENTERS = {
    "Mysore Road": (12.9250, 77.5937),
    "Bellary Road 1": (13.0467, 77.5971),
    "Tumkur Road": (13.0262, 77.5442),
    "Bellary Road 2": (13.0800, 77.6100),
    "Hosur Road": (12.9178, 77.6226),
    "ORR North 1": (13.0403, 77.6186),
    "Old Madras Road": (12.9716, 77.6412),
    "Magadi Road": (12.9716, 77.5396),
    "ORR East 1": (12.9698, 77.7499),
    "ORR North 2": (13.0524, 77.5428),
    "Bannerghatta Road": (12.9072, 77.5931),
    "ORR East 2": (12.9800, 77.7500),
    "West of Chord Road": (12.9789, 77.5993),
    "ORR West 1": (12.9786, 77.5632),
    "ORR South 1": (12.8500, 77.6500),
    "Kanakapura Road": (12.9400, 77.5500),
    "Sarjapur Road": (12.9100, 77.7200),
    "Hennur Road": (13.0450, 77.6500),
    "Airport New South Road": (13.0284, 77.6400),
    "ORR West 2": (12.9600, 77.5300),
    "ORR South 2": (12.8200, 77.6800),
}

# Parallel routes: corridor → (start, end, [(name, (lat,lon) a, (lat,lon) b), ...]).
CORRIDOR_ROUTES = {
    "Mysore Road": ((12.9250, 77.5937), (12.9500, 77.5700), [
        ("Kanakapura Road", (12.9400, 77.5500), (12.9550, 77.5650)),
        ("Chord Road Extension", (12.9300, 77.5750), (12.9480, 77.5620))]),
    "Bellary Road 1": ((13.0467, 77.5971), (13.0800, 77.6100), [
        ("BEL Road", (13.0500, 77.6000), (13.0750, 77.6150)),
        ("Hennur Road", (13.0450, 77.6500), (13.0700, 77.6600))]),
    "Hosur Road": ((12.9178, 77.6226), (12.8456, 77.6603), [
        ("Bannerghatta Road", (12.9072, 77.5931), (12.8500, 77.6000)),
        ("ORR South", (12.8800, 77.6400), (12.8200, 77.6800))]),
}

# Route colours (default "#3b82f6").
ROUTE_COLORS = {"alternate_1": "#10b981", "alternate_2": "#f59e0b", "alternate_3": "#ef4444",
                "closure": "#6b7280"}

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Default map point when no coordinates are known.
DEFAULT_POINT = (12.9716, 77.5946)

# ---------------------------------------------------------------------------------------------


def map_dim(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), [key, value])


def corridor_tier_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in CORRIDOR_TIERS.items()],
                                 "corridor string, tier int")


def centroid_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in CORRIDOR_CENTERS.items()],
                                 "corridor string, center_lat double, center_lon double")


def literal_map(mapping: dict):
    """A ``create_map`` literal: folded into the expression, no join at all."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)
