"""Thresholds in whole milliseconds, and word lists. All are defaults of parameters."""

from __future__ import annotations

# Fixed values.
FILLERS = ("um", "uh", "uhm", "erm", "mm", "you know")
MONEY = (
    "money", "cash", "dollar", "dollars", "rich", "wealth", "wealthy", "thousand", "thousands", "million", "millions", "millionaire",
    "billion", "billions", "billionaire", "trillion", "trillions", "fortune", "profit", "profits", "payday",
)
NEGATIVE = (
    "wrong", "incorrect", "lose", "lost", "loses", "losing", "loss", "losses", "crash", "crashed", "crashes", "crashing",
    "rug", "rugged", "rugpull", "rugpulled", "scam", "scams", "scammed", "scammer", "scammers", "fail", "failed", "fails", "failing", "failure",
    "bankrupt", "bankruptcy", "broke", "busted", "dumped", "dumping", "rekt", "rip",
)
SLOT_GAIN = {"swipe-in": 0.55, "swipe-out": 0.45, "hook-impact": 0.7, "cash-register": 0.85, "wrong-answer": 0.7, "ding": 0.7, "whoosh": 0.55}
EFFECTS = {"hook-impact": ("glare", "zoom-punch", "flash"), "ding": ("glare",), "cash-register": ("glare", "flash"), "wrong-answer": ("flash", "zoom-punch")}
EFFECT_COLORS = {"hook-impact": "#ffffff", "ding": "#f5c842", "cash-register": "#f5c842", "wrong-answer": "#ff3653"}
EFFECT_MS = {"glare": 280, "zoom-punch": 220, "flash": 90}

#: Files that each slot has in the queries' pack, taken in turn; a slot without any gives no event.
SLOT_FILES = {"swipe-in": 3, "swipe-out": 2, "hook-impact": 1, "cash-register": 2, "wrong-answer": 3, "ding": 4}

STUTTER_GAP, STUTTER_LEAST = 350, 20
FILLER_PAD = 60
SILENCE, SILENCE_MARGIN, SILENCE_LEAST = 800, 300, 50
MERGE_GAP = 20
PHRASE_GAP, PHRASE_WORDS = 450, 4
SNAP_WINDOW, SNAP_SILENCE, SNAP_BREATH = 600, 200, 350
SAME_EVENT = 80
FREE_GAP, FREE_MARGIN = 2400, 200
FIT_LEAST, FIT_MOST = 2000, 4500

#: Frequent words of the driver's tables, in the lists' places, since their invented texts hold none of the words above.
TABLE_FILLERS = (*FILLERS, "of", "und", "que", "in the", "la de")
TABLE_MONEY = (*MONEY, "with", "ist")
TABLE_NEGATIVE = (*NEGATIVE, "was", "par")
