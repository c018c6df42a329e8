"""Word lists, patterns, thresholds, labels and message formats.

Results depend on these exact values, so they are stated here as plain text and
nowhere else. Nothing in this module computes anything.
"""

# ---------------------------------------------------------------- file admission
ALLOWED_EXTENSIONS = ("pdf", "docx", "txt")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_QUESTION_CHARS = 2000
MAX_HISTORY_TURNS = 50

# ---------------------------------------------------------------- domains
DOMAINS = ("legal", "finance", "healthcare", "enterprise")
FALLBACK_DOMAIN = "enterprise"
CLASSIFY_SAMPLE_CHARS = 5000

DOMAIN_KEYWORDS = {
    "legal": (
        "contract", "clause", "agreement", "liability", "indemnity", "jurisdiction", "arbitration",
        "warranty", "termination", "confidentiality", "plaintiff", "defendant", "statute", "compliance",
        "regulation", "legal", "law", "court", "attorney", "counsel", "tort", "negligence", "breach",
    ),
    "finance": (
        "revenue", "profit", "loss", "balance sheet", "cash flow", "audit", "tax", "investment",
        "portfolio", "risk", "dividend", "equity", "debt", "interest rate", "fiscal", "financial",
        "bank", "loan", "credit", "asset", "liability", "shareholder", "quarterly", "annual report",
    ),
    "healthcare": (
        "patient", "diagnosis", "treatment", "clinical", "medical", "hospital", "drug", "therapy",
        "symptom", "disease", "health", "pharmaceutical", "dosage", "trial", "fda", "surgery", "nurse",
        "physician", "pathology", "radiology", "oncology", "cardiology", "epidemiology", "vaccine",
    ),
    "enterprise": (
        "policy", "employee", "hr", "onboarding", "training", "procedure", "guideline", "workflow",
        "sop", "handbook", "department", "organization", "management", "operations", "strategy", "kpi",
        "performance", "compliance", "memo", "internal", "corporate", "team", "project",
    ),
}

# ---------------------------------------------------------------- search
STOPWORDS = tuple(
    "a an the of and or to in on for by with from as at is are was were be been this that these "
    "those it its our we us their they which who whom what how any all such other than not no "
    "has have had will would shall may can do does".split()
)
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.5, 0.75, 0.25
CANDIDATES_PER_LIST = 50
RRF_CONSTANT = 60
TOP_K_GENERAL, TOP_K_OFFER = 5, 6
PREVIEW_CHARS = 200
WEAKER_MATCH_MARGIN, LOW_CONFIDENCE = 0.1, 0.5

# ---------------------------------------------------------------- chunking (size, overlap), separators in order
GENERAL_CHUNKS = (500, 50)
OFFER_CHUNKS = (800, 100)
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# ---------------------------------------------------------------- conversations
HISTORY_TURNS, HISTORY_CHARS = 6, 1500
TRIMMED_SUFFIX = " [...]"

# ---------------------------------------------------------------- document structure
SECTION_PREFIX = r"(?i)^SECTION\s+[IVXL]+\s*[-–—:]?\s*"
SECTION_PATTERNS = {
    "summary": r"^SUMMARY OF (THE )?(OFFER|ISSUE) DOCUMENT|^OFFER DOCUMENT SUMMARY",
    "risk_factors": r"^RISK FACTORS",
    "summary_financials": r"^SUMMARY (OF )?FINANCIAL INFORMATION",
    "capital_structure": r"^CAPITAL STRUCTURE",
    "objects": r"^OBJECTS? OF THE (OFFER|ISSUE)",
    "basis_for_price": r"^BASIS FOR (THE )?(OFFER|ISSUE) PRICE",
    "industry": r"^INDUSTRY OVERVIEW",
    "business": r"^OUR BUSINESS",
    "management": r"^OUR MANAGEMENT",
    "promoters": r"^OUR PROMOTERS?\b",
    "restated_financials": r"^RESTATED\b.*FINANCIAL (INFORMATION|STATEMENTS)",
    "other_financial_info": r"^OTHER FINANCIAL INFORMATION",
    "mdna": r"^MANAGEMENT.S DISCUSSION AND ANALYSIS",
    "indebtedness": r"^FINANCIAL INDEBTEDNESS",
    "litigation": r"^OUTSTANDING LITIGATION",
    "approvals": r"^GOVERNMENT AND OTHER APPROVALS",
    "the_offer": r"^THE (OFFER|ISSUE)$",
    "general_information": r"^GENERAL INFORMATION",
    "related_party": r"^(SUMMARY OF )?RELATED PARTY TRANSACTIONS",
    "history": r"^HISTORY AND CERTAIN CORPORATE MATTERS",
    "group_companies": r"^(OUR )?GROUP COMPANIES",
}
REQUIRED_SECTIONS = ("risk_factors", "summary_financials", "objects", "business", "promoters", "litigation")
SKIPPED_SECTIONS = (
    r"^(MAIN PROVISIONS OF THE ARTICLES|DEFINITIONS AND ABBREVIATIONS|(ISSUE|OFFER) PROCEDURE"
    r"|KEY REGULATIONS AND POLICIES|OTHER REGULATORY AND STATUTORY DISCLOSURES"
    r"|STATEMENT OF (POSSIBLE )?SPECIAL TAX BENEFITS|TERMS OF THE (ISSUE|OFFER)"
    r"|CERTAIN CONVENTIONS|FORWARD-LOOKING STATEMENTS|DECLARATION"
    r"|MATERIAL CONTRACTS AND DOCUMENTS|RESTRICTIONS ON FOREIGN OWNERSHIP)"
)
TOC_SEARCH_PAGES, TOC_MAX_PAGES, TOC_MIN_ENTRIES, TOC_MAX_PENDING = 20, 4, 5, 150
TOC_ENTRY = r"^(.*?)\s*[.…]{4,}\s*(\d{1,4})\s*$"
PAGE_NUMBER_LINE = r"(?i)^(?:page\s*[|:]?\s*)?(\d{1,4})$"
MAX_COVER_PAGES = 60
TITLE_PROBE_CHARS = 30
TITLE_SHIFTS = (0, 1, -1, 2, -2, 3, -3)
RISK_HEADING = r"^(\d{1,3})[.)](?:\s+|(?=[“\"‘']?[A-Z])|$)(.*)$"
RISK_NUMBER_GAP = 3
BOLD_SHARE = 0.8
NONE_PLEDGED = r"(?i)none of the equity shares held by (?:our |the )?promoters?\b[^.]{0,120}?\b(?:is|are) pledged"
PENDING_WORDING = r"(?i)applied for|not yet (?:been )?received|yet to (?:be )?(?:apply|obtain)|expired"

# ---------------------------------------------------------------- statements
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December")
STATEMENTS = {
    "balance_sheet": r"(?i)ASSETS AND LIABILITIES|BALANCE SHEET",
    "profit_and_loss": r"(?i)PROFIT AND LOSS|PROFIT & LOSS",
    "cash_flow": r"(?i)CASH FLOW",
}
STATEMENT_TITLE_CHARS = 600
LINE_ITEMS = {
    "profit_and_loss": {
        "revenue_from_operations": r"^revenue from operations",
        "other_income": r"^other income",
        "total_income": r"^total (income|revenue)",
        "finance_costs": r"^finance costs?",
        "depreciation": r"^depreciation",
        "total_expenses": r"^total expenses",
        "profit_before_tax": r"^(?!.*exceptional).*before tax",
        "profit_for_period": r"^(net )?profit.{0,12}for the (year|period)(?!.*(continuing|discontinued|attributable))",
        "eps_basic": r"^basic",
    },
    "balance_sheet": {
        "total_assets": r"^total assets",
        "total_current_assets": r"^total current assets",
        "total_current_liabilities": r"^total current liabilities",
        "total_equity": r"^total equity(?! and)",
        "cash_and_equivalents": r"^cash (and|&) cash equivalents",
        "trade_receivables": r"^trade receivables",
        "inventories": r"^inventories",
        "borrowings": r"^(non-current |current )?borrowings",
    },
    "cash_flow": {
        "operating_cash_flow": r"^net cash.*operating",
        "investing_cash_flow": r"^net cash.*investing",
        "financing_cash_flow": r"^net cash.*financing",
        "capex": r"^\(?(purchase|acquisition|investments?|payments?)\)?\s*(of|in|for)\s+property,? plant",
    },
}
SUMMED_ITEMS = ("borrowings",)
PER_SHARE_ITEMS = ("eps_basic",)
NIL_WORDS = ("-", "–", "—", "nil")
NUMBER_CELL = r"^\(?-?(\d{1,3}(,\d{2,3})+|\d+)(\.\d+)?\)?$"
LABEL_MARKERS = r"^((\(?[a-z0-9]{1,4}[.)])\s*|[-•]\s*)+"
YEAR_RANGE = (1990, 2100)
UNITS_TO_MILLION = {"rupees": 1e-6, "thousand": 1e-3, "lakh": 0.1, "million": 1.0, "crore": 10.0}
UNIT_SEARCH_ORDER = ("million", "crore", "lakh")
FIGURE = r"\d[\d,]*(?:\.\d+)?"
INLINE_FACT_IDS = r"\s*\((?:[FRBOL]\d+[,;\s]*)+\)"
IDENTITY_TOLERANCE = 0.01

# ---------------------------------------------------------------- metrics (in report order)
METRICS = (
    "revenue", "revenue_growth", "ebitda", "ebitda_margin", "pat", "pat_margin", "roe", "debt_to_equity",
    "interest_coverage", "current_ratio", "receivable_days", "inventory_days", "operating_cash_flow",
    "cash_conversion", "free_cash_flow", "other_income_share",
)
GROWTH_SERIES = ("revenue", "ebitda", "pat", "trade_receivables", "borrowings")
JUMP_ITEMS = {
    "cash_and_equivalents": "Cash and cash equivalents",
    "trade_receivables": "Trade receivables",
    "inventories": "Inventories",
    "total_current_assets": "Current assets",
    "total_current_liabilities": "Current liabilities",
    "borrowings": "Borrowings",
    "operating_cash_flow": "Operating cash flow",
}
FLOW_ITEMS = ("operating_cash_flow",)
JUMP_RATIO, JUMP_MIN_SHARE = 3.0, 0.05

# ---------------------------------------------------------------- scorecard wording
SCORECARD_TEXT = {
    "no_years": "No full financial years found",
    "growth_unknown": "Not enough full years to measure revenue growth",
    "growth": "Revenue {verb} {cagr}% a year ({span})",
    "profitability_unknown": "Margins couldn't be calculated",
    "profitability": "EBITDA margin {first}% → {last}% ({span}); {note}",
    "losses_in": "losses in {years}",
    "no_losses": "profitable every year",
    "leverage_unknown": "Debt to equity couldn't be calculated",
    "leverage": "Debt to equity {de}x ({latest}){cover}",
    "cover": "; operating profit covers interest {cover}x ({last})",
    "liquidity_unknown": "Current ratio couldn't be calculated",
    "liquidity": "Current ratio {ratio}x ({latest})",
    "cash_unknown": "No operating cash flow figures",
    "cash_negative": "Operating cash flow was negative in {years}",
    "cash_ratio": "Operating cash flow was {ratio}x profit after tax over {span}",
    "cash_positive": "Operating cash flow was positive every year despite accounting losses",
    "capital_unknown": "Receivable and inventory days couldn't be calculated",
    "receivable_note": "receivable days {a} → {b}",
    "inventory_note": "inventory days {a} → {b}",
    "returns_unknown": "Return on equity couldn't be calculated",
    "returns": "Return on equity {roe}% ({last})",
}
DIMENSIONS = ("growth", "profitability", "leverage", "liquidity", "cash_conversion", "working_capital", "returns")

# ---------------------------------------------------------------- financial flags wording
FINANCIAL_FLAG_TEXT = {
    "losses": "Net loss in {list}",
    "negative_cash_flow": "Operating cash flow was negative in {list}",
    "period_amount": "{period} (₹{amount} m)",
    "weak_cash_conversion": "Only {share}% of profit after tax turned into operating cash ({first}→{last})",
    "falling_margin": "EBITDA margin fell from {a}% ({first}) to {b}% ({last})",
    "high_debt": "Debt is {de}x equity ({latest})",
    "rising_debt": "Debt to equity rose from {a}x ({first}) to {b}x ({latest})",
    "rising_debt_growth": "Borrowings grew {debt}% a year, faster than revenue's {revenue}% ({first}→{last})",
    "low_interest_cover": "Operating profit covered interest only {cover}x in {last}",
    "low_liquidity": "Current liabilities exceed current assets (current ratio {ratio}x, {latest})",
    "receivables_outpacing_revenue": (
        "Trade receivables grew {receivables}% a year against revenue's {revenue}%, so customers took "
        "{a} → {b} days to pay ({first}→{last}): check how revenue is recognised"
    ),
    "slow_collections": "Customers take about {days} days to pay ({last})",
    "other_income_dependence": "Other income was a large share of profit before tax: {list}",
    "share_in_period": "{share}% in {period}",
    "jump_up": "{name} up {ratio}x (₹{a} m → ₹{b} m)",
    "jump_down": "{name} down {drop}% (₹{a} m → ₹{b} m)",
    "unusual_jump": "Unusual changes from {older} to {newer}: {parts}. Worth checking in the notes to the accounts",
}

# ---------------------------------------------------------------- risk register
RISK_CATEGORIES = ("business", "financial", "regulatory_legal", "litigation", "management", "macroeconomic",
                   "offer_shares")
HEADLINE_WORDS = 14
HEADING_CHARS = 1200
ANSWER_TOKENS_PER_RISK, REASONING_TOKENS = 40, 500
CALL_TOKEN_LIMIT = 6400

# ---------------------------------------------------------------- legal
CASE_TYPES = ("criminal", "regulatory", "sebi_disciplinary", "tax", "civil")
PARTIES = ("company", "subsidiary", "promoter", "director", "group_company", "key_management")
CORE_PARTIES = ("company", "subsidiary", "promoter", "director")
ALWAYS_AGAINST = ("tax", "regulatory", "sebi_disciplinary")
DIRECTION_WORDS = r"(?i)\bagainst\b|\bby\b"
HEADING_PARTIES = {
    "key_management": r"(?i)key managerial|senior management",
    "subsidiary": r"(?i)subsidiar",
    "group_company": r"(?i)group compan",
    "director": r"(?i)director",
    "promoter": r"(?i)promoter",
    "company": r"(?i)\bcompany\b",
}
LEGAL_FLAG_TEXT = {
    "criminal_cases": "{n} criminal proceeding(s) against the company, its promoters or directors",
    "sebi_action": "Disciplinary action by SEBI or a stock exchange against the promoters",
    "regulatory_actions": "{n} action(s) by regulators or statutory authorities",
    "large_claims": "Claims against the company, promoters and directors total ₹{amount} m, {share}% of net worth",
    "tax_cases": "{n} tax proceeding(s) involving ₹{amount} m",
    "approvals_not_applied": "{n} required approval(s) not yet applied for",
    "approvals_pending": "{n} approval(s) applied for but not yet received",
    "approvals_missing": "The document says some material approvals are missing",
}
BATCH_TOKENS = 3600

# ---------------------------------------------------------------- offer
DEBT_PURPOSE = r"(?i)repay|prepay|borrowing|loan|debt"
OFFER_FLAG_TEXT = {
    "mostly_offer_for_sale": (
        "{pct}% of the shares on offer are sold by existing shareholders; that money goes to them, not the company"
    ),
    "offer_for_sale": "{pct}% of the shares on offer are sold by existing shareholders",
    "promoters_selling": "Promoters or the promoter group are selling shares in the offer",
    "vague_general_purposes": (
        "{pct}% of the fresh issue is for general corporate purposes, which needn't be specified"
    ),
    "vague_unspecified": (
        "Up to {pct}% of the fresh issue isn't tied to a stated object (general corporate purposes plus issue expenses)"
    ),
    "mostly_debt_repayment": (
        "{pct}% of the stated uses repay borrowings: this lowers interest costs rather than funding growth"
    ),
    "dilution": "New shares will make up {pct}% of all shares after the offer",
}
EXCERPT_OVERHEAD_TOKENS = 6
PAGE_EXCERPT_CHARS = 4000

# ---------------------------------------------------------------- rubric
PARTS = (("financial", "Financial health", 30.0), ("risk", "Risk factors", 20.0),
         ("business", "Business & promoters", 20.0), ("legal", "Legal & approvals", 15.0),
         ("offer", "Offer structure", 15.0))
SIGNAL_POINTS = {"positive": 1.0, "neutral": 0.5, "negative": 0.0, "unknown": 0.5}
FLAG_COSTS = {"red": 3, "amber": 1}
MAX_FLAG_PENALTY = 12
HOLDING_POINTS = {"high": 10, "moderate": 6, "low": 2, "unknown": 5}
RATINGS = ((65.0, "Leans Subscribe"), (45.0, "Neutral"), (0.0, "Leans Avoid"))
RUBRIC_TEXT = {
    "unavailable": "The {agent} agent didn't finish, so this part gets half marks",
    "deduct": "-{points}: {reason}",
    "scorecard": "Scorecard: {positive} positive, {neutral} neutral, {negative} negative of {n}",
    "average": "Average risk score {average} out of 5 across {total} risk factors",
    "severe": "{n} risk(s) scored 5, a threat to the core business",
    "holding": "+{points}: {reason} ({level} stake)",
    "pledge": "+{points}: promoter shares pledged: {word}",
    "governance": "+{points}: {n} governance concern(s) found",
    "criminal": "{n} criminal case(s) against",
    "sebi": "SEBI or stock exchange action against the promoters",
    "regulatory": "{n} regulatory action(s) against",
    "claims": "claims against total {share}% of net worth",
    "not_applied": "required approvals not yet applied for",
    "approvals_missing": "the document says material approvals are missing",
    "legal_clean": "No criminal, regulatory or large claims against the company, promoters or directors",
    "offer_for_sale": "{pct}% of the shares offered are sold by existing shareholders",
    "promoters_selling": "promoters or the promoter group are selling shares",
    "vague": "over 20% of the fresh issue isn't tied to a stated use",
    "offer_clean": "No concerns in how the offer is structured",
    "knockout_financial": "Financial health scored {points}/{max}, under 40%",
    "knockout_legal": "Criminal or SEBI proceedings against the company, promoters or directors",
    "holding_known": "Promoters hold {holding}% before the offer",
    "holding_unknown": "The promoters' holding isn't stated",
}

# ---------------------------------------------------------------- jobs
STEPS = ("parse", "index", "risk", "financial", "legal", "business", "offer", "score", "synthesis")
STEP_STATUS = {"started": "running", "progress": "running", "waiting": "running", "done": "done", "failed": "failed"}
TOKENS_PER_MINUTE, OUTPUT_TOKENS_PER_MINUTE = 8000, 1000
ACCURACY_TOLERANCE, ACCURACY_ABSOLUTE = 0.005, 0.01

# What is said of a number that its source does not state
LEFT_OUT = "{field} ({value}) isn't in the excerpts, so it was left out"
OBJECT_FIELD = "amount for '{purpose}'"
DROPPED_FACTS = "{label}: dropped unknown fact ids [{ids}]"
