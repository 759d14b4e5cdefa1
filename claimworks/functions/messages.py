"""Fixed sentences of results: notices, details of aspects, reasons of decisions, service messages."""

# fixed values: notices
NOT_ENGLISH = "The rule engine only reads English. Use the fact-check lookup for this text."
DEBUNKS = "This text appears to debunk a claim. Verify the original claim instead."

# fixed values: details of aspects (found, not found)
DETAILS = {
    "sensational": ("", "No obvious sensational or hype vocabulary detected."),
    "attribution": (
        "The text names a source — claimed attribution, unverified until checked at the source. It does not make the claim more credible.",
        "No source is named for the claim.",
    ),
    "emotion": ("Emotive framing is used where neutral reporting language would be expected.", "Tone reads as broadly neutral."),
    "urgency": ("Contains pressure to share or act before checking — a common forward-chain marker.", "No forwarding pressure or artificial deadline detected."),
    "specificity": ("", "No dates or figures — the claim is hard to pin down."),
    "style": ("Heavy capitalisation or repeated exclamation — typical of forwarded messages.", "Capitalisation and punctuation are within normal range."),
    "clickbait": ("Uses curiosity-gap headline formulas rather than stating the news.", "States the claim directly rather than teasing it."),
    "corroboration": ("", "Not checked yet. Confirm the claim with the official sources listed below."),
}
ONLY_NAMED = "A body is named, but nothing is attributed to it. Naming a body is not attribution."

# fixed values: headlines of decisions by rule ("back": a credible outcome taken back)
HEADLINES = {
    "a": "Likely misleading — a published fact-check disputes this claim.",
    "b": "Likely credible — a published fact-check rates this claim true.",
    "c": "Likely credible — independent reputable outlets report the same claim.",
    "back": "Unverified — the retrieved evidence conflicts on this claim.",
    "f": "Unverified — nothing in our sources settles this. Check the official desks below before sharing.",
}

# fixed values: reasons of decisions
RATED = (" rated it “", "”.", "” — partly true.")
LOUD = "The wording also shows high risk signals (tone and pressure only, not facts)."
OTHERS_TRUE = "Other fact-checks rated a similar claim true — read each review."
READ_SUPPORTS = "The grounded AI read thinks the evidence supports the claim — read the reviews yourself."
READ_CONFLICTS = "The grounded AI read found a contradiction within the retrieved evidence."
READ_AGREES = "The grounded AI read agrees the cited evidence supports the claim."
OUTLETS = ("Reported by ", " independent reputable outlets: ", ".")
ONE_OUTLET = ("Only one reputable outlet (", ") reported it — two are needed.")

# fixed values: next steps by outcome
STEPS = {
    "a": ["Open the fact-check linked below and read the full review before sharing."],
    "credible": ["Open the linked sources to confirm the details match what you received."],
    "f": [
        "Search the official desks listed below for a statement on this exact claim.",
        "Look for the original source: who first said it, where and when.",
        "Check PIB Fact Check and established fact-checkers before sharing.",
    ],
}

# fixed values: messages of the model service by status, and of any other status
GATEWAY = {
    402: "The AI workspace is out of credits — add credits to run the AI read.",
    403: "The AI read is not available for this workspace.",
    429: "Too many AI requests right now — try again in a moment.",
}
BUSY = "The AI service is busy right now — please try again in a few seconds."

# fixed values: messages of the lookups
FACTS_UNCONFIGURED = "Fact-check lookup not configured."
FACTS_REJECTED = "The fact-check service rejected the request."
FACTS_LATE = "The fact-check service didn't answer in time."
NEWS_SHORT = "Not enough distinctive words to search news coverage."
NEWS_DOWN = "News search is unavailable right now."
NEWS_BUSY = "News search is busy right now."
NEWS_LATE = "News search timed out."
READ_UNCONFIGURED = "AI read not configured."
READ_SKIPPED = "Skipped — no fact-checks or news coverage to reason over."
READ_REFUSED = "The AI answer was rejected because it did not stick to the evidence."
PLAN_SKIPPED = "Skipped by plan — enough evidence without it."

# fixed values: texts of aspect evidence (count and noun come before the first ones)
DETECTED = " detected."
CHECKABLE = " you can check. Specifics are not proof."
UPPERCASE = "% uppercase letters"
MARKS = " exclamation/question marks"

# fixed values: image types
IMAGES = ["image/png", "image/jpeg", "image/jpg", "image/webp"]

# fixed values: sample claims
SAMPLES = [
    "SHOCKING: Doctors hate this miracle cure that reverses diabetes overnight! Share before it is deleted from the internet forever!!!",
    "According to a statement issued by the Ministry of Health and Family Welfare on 12 March 2025, the national measles-rubella campaign has reached 94 percent coverage across 28 states.",
    "Leaked documents allegedly expose a secret plan by officials to ban all cash transactions from next month, sources claim.",
    "The Reserve Bank of India announced in its monetary policy statement that the repo rate will remain unchanged at 6.5 percent, citing inflation data published by MoSPI.",
    "URGENT: Forward this to 10 people immediately — the government is switching off all mobile SIM cards that are not linked to Aadhaar by Friday!",
    "ISRO confirmed that the launch window for the next earth-observation satellite opens on 4 April 2025, according to a press release from the space agency.",
    "Unbelievable! A viral video claims the new expressway collapsed within a week, but no evidence has been provided by anonymous accounts sharing it.",
    "The India Meteorological Department issued an orange alert for coastal districts, forecasting rainfall of 115 mm over the next 24 hours.",
]
