"""Fixed values of the news domain: theme vocabulary, event codes, tiers, trust levels, weights."""

from __future__ import annotations

#: The controlled theme vocabulary, in code-point order.
THEMES = [
    "ai", "autonomous_vehicles", "biotech", "blockchain", "china", "cloud", "commodities", "consumer", "credit",
    "cybersecurity", "defense", "energy_transition", "esg", "ev_battery", "fintech", "fx", "geopolitical", "india",
    "japan", "korea", "m_and_a", "rates", "real_estate", "semiconductor", "supply_chain",
]

#: Extracted event codes and the graph's category of each; OTHER has none.
EVENT_CATEGORY = {
    "EARNINGS_BEAT": "EARNINGS",
    "EARNINGS_MISS": "EARNINGS",
    "EARNINGS_WARNING": "EARNINGS",
    "GUIDANCE_RAISE": "EARNINGS",
    "GUIDANCE_CUT": "EARNINGS",
    "M&A_ANNOUNCE": "M&A",
    "M&A_RUMOR": "M&A",
    "IPO": "M&A",
    "SECONDARY": "M&A",
    "BUYBACK": "M&A",
    "DIVIDEND_CHANGE": "EARNINGS",
    "ACTIVIST": "M&A",
    "INSIDER_TXN": "EXEC_CHANGE",
    "INDEX_ADD": "REGULATORY",
    "INDEX_DELETE": "REGULATORY",
    "INDEX_REBAL": "REGULATORY",
    "RATING_UPGRADE": "EARNINGS",
    "RATING_DOWNGRADE": "EARNINGS",
    "FDA_APPROVAL": "FDA_APPROVAL",
    "FDA_REJECTION": "FDA_APPROVAL",
    "LEGAL_RULING": "LITIGATION",
    "FRAUD_SCANDAL": "LITIGATION",
    "MGMT_CHANGE": "EXEC_CHANGE",
    "PRODUCT_LAUNCH": "PRODUCT_LAUNCH",
    "CONTRACT_WIN": "PRODUCT_LAUNCH",
    "CONTRACT_LOSS": "PRODUCT_LAUNCH",
    "MACRO_DATA": "MACRO_ECON",
    "CENTRAL_BANK": "MACRO_ECON",
    "GEOPOLITICAL": "MACRO_ECON",
    "POSITIVE_SENTIMENT": "EARNINGS",
    "NEGATIVE_SENTIMENT": "EARNINGS",
    "OTHER": None,
}

#: Impact tiers from the highest, with the score from which the test view derives each and a decay a day.
TIERS = ["PLATINUM", "GOLD", "SILVER", "BRONZE", "STANDARD"]
TIER_FROM = {"PLATINUM": 90, "GOLD": 75, "SILVER": 50, "BRONZE": 30}
TIER_DECAY = {"PLATINUM": 0.05, "GOLD": 0.10, "SILVER": 0.15, "BRONZE": 0.20, "STANDARD": 0.30}

#: Trust by level.
TRUST = {"high": 1.0, "medium": 0.75, "low": 0.5, "unverified": 0.25}
TRUST_POINTS = {"high": 10, "medium": 7, "low": 5, "unverified": 3}

#: Client types of the market segments, and score weights (semantic, graph, impact, recency).
CLIENT_TYPES = {
    "AUTOMOBILE": "HEDGE_FUND",
    "BUILDING": "PENSION",
    "FURNITURE": "LONG_ONLY",
    "HOUSEHOLD": "FAMILY_OFFICE",
    "MACHINERY": "ADVISOR",
}
WEIGHTS = {"default": (0.35, 0.35, 0.20, 0.10), "PENSION": (0.30, 0.30, 0.20, 0.20), "LONG_ONLY": (0.30, 0.30, 0.20, 0.20)}

REGIONS = ["AFRICA", "ASIA_PACIFIC", "EUROPE", "LATIN_AMERICA", "MIDDLE_EAST", "NORTH_AMERICA"]
PUBLIC_GROUP = 0
NOW = "2024-01-31 00:00:00"
