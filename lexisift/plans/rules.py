"""Rule tables of the question transformer, as data: the engine in operators/transform takes them as parameters."""

from __future__ import annotations

# Question types in order; the default and the auxiliaries of a polar question depend on the domain.
_FORMS = (
    ("WH_HOW_MANY", r"\bhow\s+many\b"), ("WH_HOW_MUCH", r"\bhow\s+much\b"), ("WH_WHY", r"\bwhy\b"), ("WH_HOW", r"\bhow\b"), ("WH_WHEN", r"\bwhen\b"), ("WH_WHERE", r"\bwhere\b"),
    ("WH_WHO", r"\bwho\b|\bwhom\b"), ("WH_WHICH", r"\bwhich\b"), ("DEFINITION", r"\bwhat\s+is\s+(?:a|an|the)\b"), ("WH_WHAT", r"\bwhat\b"), ("EXISTENCE", r"\bis\s+there\b|\bare\s+there\b|\bexists?\b"),
)
QUESTION_FORMS = {
    "finance": (*_FORMS, ("POLAR", r"^(?:can|could|does|do|is|are|was|were|will|would|has|have|had|should|must)\b")),
    "legal": (*_FORMS, ("POLAR", r"^(?:did|does|do|is|are|was|were|has|have|had|will|would|can|could|should)\b")),
    "telco": (*_FORMS, ("IMPERATIVE", r"^(?:show|list|give|tell|describe|explain|find|display)\b"), ("POLAR", r"^(?:is|are|does|do|will|can|has|have|was|were|should|could|would)\b")),
}
FORM_DEFAULT = {"finance": "POLAR", "legal": "WH_WHAT", "telco": "POLAR"}

# Intents in order, matched on lower-cased text.
INTENTS = {
    "finance": (
        ("SELECT_DEFINITION", r"\bwhat\s+(?:constitutes?|is\s+(?:a|an|the)\s+definition\s+of|does\s+.*\s+mean|is\s+considered|counts?\s+as|qualifies?\s+as)\b"),
        ("SELECT_RISK_METRICS", r"\b(?:capital\s+ratio|capital\s+requirement|stress\s+test|value\s+at\s+risk|\bvar\b|credit\s+risk|market\s+risk|operational\s+risk|liquidity\s+ratio|risk\s+weight|leverage\s+ratio)\b"),
        ("SELECT_MARKET_DATA", r"\b(?:market\s+price|stock\s+price|exchange\s+rate|interest\s+rate|trading\s+volume|market\s+cap|volatility|benchmark\s+rate)\b"),
        ("SELECT_TECHNOLOGY", r"\b(?:internet\s+banking|two.factor|authentication|cyber|digital|e.statement|technology\s+risk|api|automated)\b"),
        ("SELECT_REPORTING", r"\b(?:financial\s+statement|annual\s+report|quarterly|revenue|net\s+income|balance\s+sheet|earnings|cash\s+flow)\b"),
        ("SELECT_COMPLIANCE", r"\b(?:regulatory\s+(?:requirement|capital|reporting|compliance)|compliance\s+(?:status|requirement)|enforcement|supervisory|examination|what\s+constitutes\s+a\s+change)\b"),
        ("SELECT_ENTITLEMENT", r"\bcan\s+i\b|\bcan\s+(?:a\s+)?customer\b|\bam\s+i\s+(?:entitled|allowed|permitted)\b|\bdo\s+i\s+have\s+(?:to|the\s+right)\b"),
        ("SELECT_OBLIGATION", r"\bbank\s+(?:must|shall|should|is\s+required)\b|\binstitution[s]?\s+(?:must|shall|should)\b|\bobligat(?:ion|ed)\b|\bduty\s+of\b"),
        ("SELECT_PROCEDURE", r"\bhow\s+(?:do|does|can|should|to)\b|\bwhat\s+(?:steps?|process|procedure)\b|\bwhat\s+should\s+(?:i|a\s+bank)\s+(?:take|do|follow)\b"),
        ("SELECT_REQUIREMENT", r"\b(?:require[sd]?|requirement|must|shall|necessary|mandatory|prohibited|permitted|obligation)\b"),
        ("ASK_EXISTS", r"\bexists?\b|\bis\s+there\b|\bare\s+there\b"),
        ("ASK_BOOLEAN", r"^(?:can|could|does|do|is|are|was|were|will|would|has|have|had|should|must)\b"),
        ("DESCRIBE_ENTITY", r"^(?:describe|what\s+is\s+(?:a|an|the)\b|tell\s+me\s+about)\b"),
    ),
    "legal": (
        ("SELECT_TIMING", r"\bwhen\s+(?:did|was|were|does|is)\b|\bwhat\s+(?:date|year|time)\b|\bcome\s+into\s+(?:effect|force)\b|\btook\s+effect\b"),
        ("SELECT_PARTIES", r"\bwho\s+(?:is|are|was|were)\s+(?:the\s+)?(?:plaintiff|defendant|appellant|respondent|applicant|parties|solicitor|counsel|judge)\b|\bparties\s+to\b|\bpresiding\s+judge\b"),
        ("SELECT_CHARGES", r"\b(?:charge[sd]?|offence[s]?|offense[s]?|plead(?:ed)?\s+guilty|convicted|indictment|crime[s]?)\b"),
        ("SELECT_DEFINITION", r"\b(?:definition|meaning|interpret(?:ation|ed)|constru(?:ed|ing)|defined)\b|\bwhat\s+(?:is|are)\s+(?:a|an|the)\b"),
        ("SELECT_REQUIREMENTS", r"\b(?:require[sd]?|obligation[s]?|duty|duties|must|shall|power[s]?|entitled|permitted|prohibited|right\s+to)\b"),
        ("SELECT_APPEAL", r"\b(?:appeal(?:ed|ing|s)?|ground[s]?\s+of\s+appeal|leave\s+to\s+appeal|court\s+of\s+appeal)\b"),
        ("SELECT_AVIATION", r"\b(?:airworthiness\s+directive|ad/[a-z0-9]+|aircraft|aeroplane|civil\s+aviation\s+regulations?)\b"),
        ("SELECT_CASE_OUTCOME", r"\b(?:outcome|decision|result|order|verdict|judgment|holding|ruling|court\s+(?:held|found|decided|ruled|dismissed|allowed|upheld|overturned)|what\s+did\s+the\s+court)\b"),
        ("SELECT_LEGAL_ARGUMENT", r"\b(?:argument|ground[s]?|submission|claim[s]?|contention|asserted|alleged|submitted|argued)\b"),
        ("SELECT_LEGISLATION", r"\b(?:act\s+\d{4}|regulations?\s+\d{4}|section\s+\d+|under\s+the\s+[A-Z]|pursuant\s+to|provides?\s+that|states?\s+that)\b"),
        ("ASK_EXISTS", r"\bexists?\b|\bis\s+there\b|\bare\s+there\b"),
        ("ASK_BOOLEAN", r"^(?:did|does|do|is|are|was|were|has|have|had|will|would|can|could|should)\b"),
        ("DESCRIBE_ENTITY", r"^(?:describe|what\s+is\s+(?:a|an|the)\s+[a-z]+\s+[a-z]+|tell\s+me\s+about)\b"),
        ("CONSTRUCT_GRAPH", r"\b(?:show\s+me\s+(?:all|the\s+full)|full\s+(?:case|graph|network))\b"),
    ),
    "telco": (
        ("SELECT_COMPATIBILITY", r"\bcompatible\s+with\b"),
        ("SELECT_COMPATIBILITY", r"\bwork\s+with\b|\bwork\s+alongside\b"),
        ("SELECT_REQUIREMENTS", r"\bwhat\s+are\s+(?:the\s+)?(?:requirements?|prerequisites?)\b"),
        ("SELECT_PROPERTY", r"\bwhat\s+(?:is|are)\s+(?:the\s+)?(?:maximum|minimum|current|)\s*(?:speed|price|cost|status|colour|color|light|version|channel)\b"),
        ("SELECT_PROPERTY", r"\bwhat\s+is\s+(?:the|a|an)\s+\w+\s+(?:of|for|on)\b"),
        ("SELECT_PROPERTY", r"\bwhat\s+is\s+the\s+\w+\s+of\b"),
        ("SELECT_REQUIREMENTS", r"\b(?:does|do|will)\b.{0,50}\b(?:require|need|depend\s+on|must\s+have|necessary)\b"),
        ("ASK_EXISTS", r"\bexists?\b|\bis\s+there\s+(?:an?|any)\b|\bare\s+there\s+any\b"),
        ("ASK_EXISTS", r"\b(?:service|broadband|internet)\s+(?:down|outage|unavailable|offline)\b"),
        ("ASK_EXISTS", r"\bis.{0,20}(?:down|offline|unavailable|not\s+working)\b"),
        ("ASK_BOOLEAN", r"^(?:is|are|does|do|will|can|has|have|was|were)\b"),
        ("ASK_BOOLEAN", r"\bcan\s+i\s+(?:use|connect|run|install|access|configure)\b"),
        ("ASK_BOOLEAN", r"\bis\s+(?:it|this|that)\s+(?:possible|available|supported|required|compatible)\b"),
        ("CONSTRUCT_GRAPH", r"\b(?:show\s+me\s+(?:all|the\s+full)|generate\s+a\s+(?:graph|diagram)|full\s+(?:graph|network|topology))\b"),
        ("SELECT_TROUBLESHOOT", r"\b(?:troubleshoot|why\s+(?:is|does|isn't|doesn't|won't|can't)|not\s+working|keeps?\s+(?:dropping|disconnecting))\b"),
        ("SELECT_ISSUES", r"\b(?:common\s+(?:issues?|problems?|faults?|errors?)|what\s+(?:issues|problems|errors|faults)\s+(?:are|does|do))\b"),
        ("SELECT_ISSUES", r"what\s+are\s+(?:the\s+)?(?:most\s+)?(?:common|known|typical|frequent)\s+(?:issues?|problems?|faults?|errors?)"),
        ("DESCRIBE_ENTITY", r"^(?:tell\s+me\s+about|describe|what\s+is\s+(?:a|an|the)|explain)\b"),
        ("DESCRIBE_ENTITY", r"\bgive\s+me\s+(?:info|details|information)\s+(?:about|on)\b"),
        ("SELECT_ACCOUNT", r"\b(?:bill|invoice|payment|direct\s+debit|contract|cancel|termination|fee|charge|refund|credit)\b"),
        ("SELECT_CONFIGURE", r"\b(?:set\s+up|configure|change|modify|reset|enable|disable|password|ssid|port\s+forward|dns\s+setting)\b"),
        ("SELECT_PROPERTY", r"\b(?:speed|price|cost|status|channel|version|light|colour|color|signal\s+strength)\b"),
    ),
}
INTENT_DEFAULT = {"finance": "SELECT_GENERAL", "legal": "SELECT_CASE_FACTS", "telco": "SELECT_GENERAL"}

# Query types of two domains and the property category of one, in order.
QUERY_TYPES = {
    "finance": (
        ("MarketData", r"market\s+price|stock\s+price|trading\s+volume|market\s+cap|price\s+history|volatil|exchange\s+rate|bid|ask\s+price|benchmark\s+rate|libor|sofr"),
        ("TradingOperations", r"trading\s+order|order\s+execution|exchange\s+member|foreign\s+banking.*(?:place|accept)\s+order|engage.*business.*united\s+states|underwriting|securities.*dealer|broker.*dealer"),
        ("CorporateFinance", r"corporate\s+(?:finance|structure|governance)|merger|acquisition|debt\s+structure|equity\s+structure|valuation\s+rule|affiliate.*liabilit|operating\s+subsidiary.*acquisition|section\s+23[AB]|valuation.*member\s+bank"),
        ("TechnologyAndFintech", r"internet\s+banking|two.factor|authentication|cyber|fintech|digital|e.statement|e-mail.*bank|notification.*email|technology\s+risk|api|automated|online\s+banking"),
        ("RegulatoryCompliance", r"aml|anti.money\s+laundering|kyc|know\s+your\s+customer|beneficial\s+owner|cdd|customer\s+due\s+diligence|terrorist\s+financing|suspicious\s+transaction|sanctions|ownership.*structure|corporate.*customer.*information"),
        ("RiskManagement", r"capital\s+(?:ratio|requirement|adequacy|buffer)|basel|stress\s+test|value\s+at\s+risk|\bvar\b|credit\s+risk|market\s+risk|operational\s+risk|liquidity\s+(?:risk|coverage|ratio)|risk\s+management|concentration\s+risk|exposure\s+limit"),
        ("InvestmentAnalysis", r"investment|portfolio|asset\s+allocation|fund\s+transfer|mutual\s+fund|etf|securities\s+purchase|asset\s+management|performance.*(?:metric|benchmark)|return\s+on"),
        ("FinancialReporting", r"revenue|net\s+income|earnings|profit|loss|balance\s+sheet|total\s+assets|shareholders\s+equity|cash\s+flow|financial\s+statement|annual\s+report|quarterly\s+report|interest\s+income|non.interest"),
        ("RegulatoryCompliance", r"regulation\s+[a-z]{1,3}\b|section\s+\d+|member\s+bank|state\s+member\s+bank|bank\s+holding\s+(?:company|act)|examination|supervisory|examiners?|examinations?|fdic|federal\s+reserve|board\s+of\s+governors|what\s+constitutes|how\s+is\s+.*\s+defined|compliance.*requirement|regulatory.*requirement"),
    ),
    "legal": (
        ("AviationLaw", r"airworthiness\s+directive|ad/[a-z]+\s*\d+|amendment.*aeroplane|aircraft.*regulation|civil aviation"),
        ("ProfessionalConduct", r"professional\s+(?:conduct|misconduct|standard)|solicitor.*disciplin|law\s+society|legal\s+practitioner.*disciplin|unsatisfactory\s+professional|bill\s+of\s+costs.*privilege|rules\s+of\s+practice.*solicitor"),
        ("RegulatoryCompliance", r"regulatory\s+compliance|compliance\s+record|notification\s+requirement|mutual\s+recognition|what\s+are\s+the\s+requirements?\s+for|requirements?\s+for\s+(?:display|notif|cabin\s+crew|hydraulic|pregnancy|corrugated|persons\s+advis)"),
        ("LegalPrinciples", r"principle[s]?\s+(?:governing|underlying|for|of\s+the\s+exercise)|general\s+principle|statement\s+of\s+principles|definition\s+of\s+[a-z].*(?:cumulative|equivalent\s+dose|malignant|hypopitu)"),
        ("CourtProcedures", r"rule\s+\d+[A-Z]?\s+of|when\s+did.*rules?\s+(?:come\s+into\s+)?(?:effect|force)|process\s+for.*assessment.*funding|road.*amendment.*rules|radiocommunications.*rules|fisheries.*rules|criteria\s+for\s+(?:different\s+)?categories"),
        ("LegalEntities", r"who\s+(?:is|are|were|was)\s+(?:the\s+)?(?:plaintiff|defendant|appellant|respondent|applicant|parties|solicitor|counsel|judge)|when\s+did\s+(?:the\s+)?(?:plaintiff|defendant)|what\s+claims?\s+are|who\s+are\s+the\s+parties|avenues?\s+for\s+an\s+applicant"),
        ("Legislation", r"act\s+\d{4}|regulation[s]?\s+\d{4}|section\s+\d+[A-Z]?\s+of\s+the"),
    ),
}
QUERY_TYPE_DEFAULT = {"finance": "BankingOperations", "legal": "CaseLaw"}
CASE_CITED = r"\[\d{4}\]\s*[A-Za-z]+\s*\d+"
PROPERTY_CATEGORIES = (
    ("legal_timing", r"when\s+did|what\s+(?:date|time|year)|how\s+long|duration|come\s+into\s+effect|commenced|took\s+effect"),
    ("legal_parties", r"who\s+(?:is|are|were|was)\s+(?:the\s+)?(?:plaintiff|defendant|appellant|respondent|applicant|parties|solicitor|judge|counsel)|what\s+.*parties"),
    ("legal_charges", r"what\s+(?:was|were|is|are)\s+the\s+(?:charge|offence|offense)|charged\s+with|pleaded\s+guilty|convicted"),
    ("legal_outcome", r"what\s+(?:was|were|is|are)\s+the\s+(?:outcome|decision|result|order|verdict|judgment|holding|ruling)|court\s+(?:held|found|decided|ruled|dismissed|allowed|upheld|overturned)"),
    ("legal_argument", r"what\s+(?:was|were|is|are)\s+the\s+(?:argument|ground|submission|reason|basis|claim)|argued\s+that|submitted\s+that"),
    ("legal_appeal", r"what\s+(?:was|were|is|are)\s+the\s+(?:appeal|ground.*appeal|appeal.*ground)|did\s+the\s+court.*appeal"),
    ("legal_definition", r"what\s+(?:is|are|was|were)\s+the\s+(?:definition|meaning|interpretation|construed|defined)"),
    ("disciplinary_action", r"disciplinar|misconduct|sanction|struck\s+off|reprimand|professional.*conduct"),
    ("legal_requirement", r"(?:require|must|shall|obligation|duty|power|right|entitled|permitted|prohibited)\s"),
    ("legal_interpretation", r"how\s+is\s+(?:the\s+)?term|what\s+(?:does|did)\s+(?:the\s+)?court\s+(?:interpret|construe|hold|find|decide|rule|view|consider|treat)|court\s+(?:interpretation|construction|view|stance|approach)|what\s+(?:is|was|were)\s+the\s+(?:test|principle|rule|basis|standard|interpretation|definition|meaning|scope|effect|construction|circumstances?|considerations?|grounds?|issues?|actions?|measures?|changes?|arguments?|obligations?|claims?|certifications?|consequences?|relationship|assessment|cause\s+of)|what\s+changes?\s+were|what\s+action[s]?\s+(?:does|did|were)|how\s+is\s+|how\s+does\s+|how\s+was\s+|why\s+(?:was|is|did|does)|consequences?\s+of|what\s+led\s+to|what\s+amount[s]?\s+to|what\s+were\s+the\s+(?:key|main|two|three|relevant|particular)"),
)
CATEGORY_DEFAULT = "legal_context"

# Variables by question type, then by intent.
FOCUS_BY_FORM = {
    "finance": {"WH_WHY": "?reason", "WH_WHEN": "?date", "WH_WHERE": "?location", "WH_WHO": "?entity", "WH_HOW_MANY": "?count", "WH_HOW_MUCH": "?amount", "WH_HOW": "?process", "DEFINITION": "?definition"},
    "legal": {"WH_WHY": "?reason", "WH_WHEN": "?date", "WH_WHERE": "?location", "WH_WHO": "?party", "WH_HOW_MANY": "?count", "WH_HOW_MUCH": "?amount", "WH_HOW": "?process", "DEFINITION": "?definition"},
    "telco": {"WH_WHY": "?cause", "WH_WHEN": "?date", "WH_WHERE": "?location", "WH_WHO": "?contact", "WH_HOW_MANY": "?count", "WH_HOW_MUCH": "?price", "WH_HOW": "?steps", "DEFINITION": "?description"},
}
FOCUS_BY_INTENT = {
    "finance": {"SELECT_REQUIREMENT": "?requirement", "SELECT_DEFINITION": "?definition", "SELECT_PROCEDURE": "?procedure", "SELECT_ENTITLEMENT": "?entitlement", "SELECT_OBLIGATION": "?obligation", "SELECT_RISK_METRICS": "?riskMetric", "SELECT_MARKET_DATA": "?marketData", "SELECT_REPORTING": "?financialData", "SELECT_COMPLIANCE": "?complianceStatus", "SELECT_TECHNOLOGY": "?techMetric"},
    "legal": {"SELECT_CASE_OUTCOME": "?outcome", "SELECT_LEGAL_ARGUMENT": "?argument", "SELECT_PARTIES": "?party", "SELECT_LEGISLATION": "?provision", "SELECT_DEFINITION": "?definition", "SELECT_TIMING": "?date", "SELECT_REQUIREMENTS": "?requirement", "SELECT_APPEAL": "?appealDetails", "SELECT_CHARGES": "?charge", "SELECT_AVIATION": "?directive", "SELECT_CASE_FACTS": "?result", "SELECT_GENERAL": "?result"},
    "telco": {},
}
FOCUS_DEFAULT = {"finance": "?result", "legal": "?result", "telco": "?answer"}

# Fields of each query type, the primary one first, and the words that speak for a field.
FIELDS = {
    "MarketData": "currentPrice priceHistory tradingVolume marketCapitalization volatilityMetrics".split(),
    "FinancialReporting": "revenue netIncome totalAssets shareholdersEquity operatingCashFlow".split(),
    "BankingOperations": "loanPortfolio depositBase netInterestMargin loanLossProvision creditQuality revenue netIncome".split(),
    "TechnologyAndFintech": "digitalAdoption technologyInvestments cybersecurityMetrics apiUsage automationLevel".split(),
    "RiskManagement": "creditRisk marketRisk operationalRisk valueAtRisk stressTestResults loanPortfolio depositBase".split(),
    "InvestmentAnalysis": "portfolioValue assetAllocation performanceMetrics riskMetrics benchmarkComparison".split(),
    "RegulatoryCompliance": "complianceStatus regulatoryCapital auditFindings enforcementActions regulatoryReporting".split(),
    "TradingOperations": "tradingVolume executionQuality tradingRevenue positionData counterpartyExposure".split(),
    "CorporateFinance": "debtStructure equityStructure costOfCapital valuationMultiples cashFlowProjections valuationMetrics balanceSheetData".split(),
}
FIELD_WORDS = {
    "loanPortfolio": ("loan", "credit", "mortgage", "borrow"), "depositBase": ("deposit", "account", "saving"), "netInterestMargin": ("interest", "margin", "rate", "nim"), "loanLossProvision": ("loss", "provision", "impairment", "write"),
    "creditQuality": ("credit quality", "default", "non.performing"), "revenue": ("revenue", "income", "earning", "profit"), "netIncome": ("net income", "profit", "earning"), "currentPrice": ("price", "market price", "current price"),
    "tradingVolume": ("volume", "trading", "trade"), "marketCapitalization": ("market cap", "capitaliz"), "volatilityMetrics": ("volatil", "var", "risk"), "creditRisk": ("credit risk", "default", "credit"),
    "marketRisk": ("market risk", "price risk", "trading"), "operationalRisk": ("operational risk", "process", "fraud"), "valueAtRisk": ("value at risk", "var", "stress"), "stressTestResults": ("stress test", "scenario", "capital"),
    "complianceStatus": ("compli", "regulat", "enforcement"), "regulatoryCapital": ("capital", "tier", "ratio", "adequacy"), "auditFindings": ("audit", "finding", "examination"), "portfolioValue": ("portfolio", "fund", "investment", "asset"),
    "assetAllocation": ("allocat", "asset class", "diversif"), "digitalAdoption": ("digital", "online", "internet", "app"), "cybersecurityMetrics": ("cyber", "security", "authentication", "hack"), "debtStructure": ("debt", "bond", "borrow", "leverage"),
    "equityStructure": ("equity", "share", "stock", "capital struct"), "costOfCapital": ("cost of capital", "wacc", "discount rate"), "valuationMultiples": ("valuation", "multiple", "pe ratio", "ebitda"),
}
CATEGORY_FIELDS = (
    ("argument", r"\bargument\b|\bclaim\b|\bsubmission\b|\bcontention\b"), ("reasoning", r"\breason\b|\breach\b|\bconsider\b|\banalys\b|\bfind\b"), ("outcome", r"\boutcome\b|\bdecision\b|\bresult\b|\border\b|\bverdict\b"),
    ("parties", r"\bpart(?:y|ies)\b|\bplaintiff\b|\bdefendant\b|\bappellant\b|\brespondent\b|\bapplicant\b"), ("judge", r"\bjudge\b|\bjustice\b|\bpresid\b"), ("statute", r"\bstatute\b|\bact\b|\blegislation\b|\bprovision\b|\bsection\b"),
    ("principle", r"\bprinciple\b|\btest\b|\brule\b"), ("appeal", r"\bappeal\b|\bground\b"), ("regulation", r"\bregulation\b|\bdirective\b"), ("charge", r"\bcharge\b|\boffence\b|\bguilty\b"),
    ("dateDecided", r"\bdate\b|\bwhen\b|\btime\b|\byear\b"), ("court", r"\bcourt\b|\btribunal\b"), ("precedent", r"\bprecedent\b|\bcited\b|\bcases?\s+cited\b"),
)
CATEGORY_FIELD_DEFAULTS = {
    "legal_context": ("argument", "reasoning", "parties"), "legal_interpretation": ("argument", "reasoning"), "legal_outcome": ("outcome", "argument", "reasoning"), "legal_parties": ("parties", "judge"), "legal_timing": ("dateDecided",),
    "legal_requirement": ("statute", "requirement"), "legal_charges": ("charge", "outcome", "reasoning"), "legal_appeal": ("appeal", "outcome", "reasoning"), "legal_argument": ("argument", "reasoning"), "legal_definition": ("statute", "principle"),
}
CATEGORY_FIELD_OTHER = ("argument", "reasoning")

# Institutes, their documents, document numbers, jurisdictions by place, court and word.
INSTITUTES = (
    ("HKMA", r"hkma|hong\s+kong|code\s+of\s+banking\s+practice|aml.*ordinance|mis.transfer|fintech.*hkma|institution[s]?\s+should"),
    ("EU", r"\beu\b|european\s+union|mifid|crd|crr|emir|regulation\s+\(eu\)|directive\s+\d{4}/\d+/eu"),
)
INSTITUTE_DEFAULT = "Federal Reserve"
DOCUMENTS = {
    "HKMA": (
        ("Anti-Money Laundering and Counter-Terrorist Financing Ordinance", r"aml|anti.money\s+laundering|beneficial\s+owner|terrorist\s+financing|ownership.*structure"),
        ("General Principles for Technology Risk Management", r"internet\s+banking|authentication|two.factor|technology\s+risk|cyber|online"),
        ("Credit Card Business", r"credit\s+card|unauthorised.*transaction"),
        ("Code of Practice on Consumer Credit Data (the Code)", r"credit\s+data|credit\s+reference"),
        ("Handling procedures for Following up Mis-transfer of Funds", r"fund\s+transfer|mis.transfer"),
        ("Code of Banking Practice", r""),
    ),
    "EU": (("REGULATION (EU)", r""),),
    "Federal Reserve": (
        ("Regulation H", r"state\s+member\s+bank|regulation\s+h\b|208"), ("Regulation K", r"foreign.*(?:bank|organization|banking)|regulation\s+k\b|211"), ("Regulation L", r"interlocking|regulation\s+l\b|212"),
        ("Regulation O", r"insider\s+loan|insider\s+credit|executive\s+officer|regulation\s+o\b|215"), ("Regulation W", r"covered\s+transaction|affiliate\s+transaction|section\s+23[AB]|valuation\s+rule|regulation\s+w\b|223"),
        ("Regulation Y", r"bank\s+holding\s+company|nonbanking\s+activit|regulation\s+y\b|225"), ("Regulation YY", r"enhanced\s+prudential|systemically\s+important|stress\s+test.*large|resolution\s+plan|regulation\s+yy\b|252"),
        ("Statement on Longer-Run Goals and Monetary Policy Strategy", r"longer.run\s+goal|monetary\s+policy\s+strategy|inflation\s+target|employment\s+goal"),
    ),
}
DOCUMENT_NUMBERS = {"208": "Regulation H", "211": "Regulation K", "212": "Regulation L", "215": "Regulation O", "223": "Regulation W", "225": "Regulation Y", "252": "Regulation YY"}
PLACES = (
    ("new south wales", "new south wales"), ("nsw", "nsw"), ("tasmania", "tasmania"), ("australian capital territory", "australian capital territory"), ("western australia", "western australia"),
    ("queensland", "queensland"), ("victoria", "victoria"), ("northern territory", "northern territory"), ("south australia", "south australia"),
)
COURTS = {
    "commonwealth": "hca aata aat", "federal": "fca fcafc fcca irca fcaa", "nsw": "nswsc nswca nswcca nswdc nswlec nswirc nswadt nswcatap nswcatad nswcatod nswcatcd nswcatgd nswadtap nswlc nswcc",
    "victoria": "vsc vsca", "queensland": "qsc qca", "western australia": "wasc wasca", "south australia": "sasc sascfc",
}
JURISDICTION_WORDS = (("commonwealth", r"\bfederal\b|\bcommonwealth\b|\bcth\b|\(cth\)"), ("federal", r""))

# Metadata patterns, service actions, states and colours of lights, entity labels with their class or data property.
METADATA = {
    "sections": r"(?:[Ss][Ee][Cc][Tt][Ii][Oo][Nn]|§)\s*(\d+[A-Za-z]?(?:\.\d+)?(?:\([a-z0-9]+\))*)",
    "regulations": r"[Rr][Ee][Gg][Uu][Ll][Aa][Tt][Ii][Oo][Nn]\s+([A-Za-z]{1,3}[A-Za-z0-9\-]*)",
    "percents": r"(\d+(?:\.\d+)?)\s*(?:percent|%)",
    "days": r"(\d+)\s*[Dd][Aa][Yy][Ss]?",
    "doc_numbers": r"\b(2\d{2})\b",
    "citations": r"(\[\d{4}\]\s*[A-Za-z]+\s*\d+)",
    "amounts": r"[£$€]\s?(\d+(?:[.,]\d+)*)",
    "acts": r"\b((?:[A-Z][a-z]+\s)+Act)\b",
}
ACTIONS = (
    ("setup", r"set\s*up|install|activate"), ("transfer", r"mov(?:e|ing)|transfer|relocat"), ("cancel", r"cancel|terminat|end\s+(?:my|the)\s+contract"), ("upgrade", r"upgrad|faster\s+plan|better\s+speed"), ("return", r"return|send\s+back|refund"),
    ("reset", r"reset|restart|reboot|factory"), ("diagnose", r"diagnos|troubleshoot|repair"), ("configure", r"configur|chang(?:e|ing)|modify|adjust"), ("inspect", r"check|view|monitor|inspect"), ("disable", r"disable|turn\s+off|switch\s+off"), ("enable", r"enable|turn\s+on|switch\s+on"),
)
LIGHTS = "blinking flashing solid steady pulsing off on dim".split()
COLOURS = "red green blue orange amber aqua purple yellow white pink".split()
ENTITY_LABELS = {
    "PERSON": ("Person", None), "NORP": ("Group", None), "FAC": ("Facility", None), "ORG": ("Organisation", None), "GPE": ("Location", None), "LOC": ("Location", None), "PRODUCT": ("FinancialProduct", None), "EVENT": ("Event", None), "LAW": ("Regulation", None),
    "DATE": (None, "hasDate"), "TIME": (None, "hasTime"), "PERCENT": (None, "hasPercentage"), "MONEY": (None, "hasAmount"), "QUANTITY": (None, "hasQuantity"), "ORDINAL": (None, "hasOrdinal"), "CARDINAL": (None, "hasCardinal"),
}

# Vocabularies of the engine's own, small on purpose; a user loads theirs in the same shape (surface -> name).
SURFACES = {
    "landlord": "Landlord", "tenant": "Tenant", "deposit": "Deposit", "lease": "Lease", "court": "Court", "clause": "Clause", "rent arrears": "RentArrears", "bank": "Bank", "margin": "Margin", "tariff": "Tariff",
    "router": "Router", "hub": "Hub", "line": "Line", "router reset": "RouterReset", "fee": "Fee", "insurer": "Insurer", "customer": "Customer", "code": "Code", "register": "Register", "request": "Request", "contract": "Contract",
    "broker": "Broker", "issuer": "Issuer", "fund": "Fund", "loan": "Loan", "bond": "Bond", "share": "Share", "notice": "Notice", "claim": "Claim", "appeal": "Appeal", "judge": "Judge", "witness": "Witness", "engineer": "Engineer", "provider": "Provider",
    "handset": "Handset", "modem": "Modem", "adapter": "Adapter", "cabinet": "Cabinet", "number": "Number", "form": "Form", "schedule": "Schedule", "receipt": "Receipt", "review": "Review", "change of address": "AddressChange", "rent": "Rent",
    "mediator": "Mediator", "guarantor": "Guarantor", "court clerk": "CourtClerk", "respondent": "Respondent", "executor": "Executor", "occupier": "Occupier", "witness statement": "WitnessStatement", "hearing fee": "HearingFee", "prepaid allowance": "PrepaidAllowance", "guest network": "GuestNetwork", "limitation period": "LimitationPeriod",
}
RELATIONS = {"allowed to": "permits", "has to": "requires", "need": "requires", "require": "requires", "pay": "pays", "apply to": "appliesTo", "still apply": "appliesTo", "keep": "keeps", "lost": "lost", "ignores": "ignores", "deal with": "handles", "refuse": "refuses", "return": "returns", "depend on": "dependsOn"}
DATA_PROPERTIES = {"within": "hasPeriod", "after": "hasStart", "until": "hasEnd", "schedule": "hasSchedule", "section": "hasSection", "below": "hasLimit", "above": "hasLimit", "fee": "hasFee", "price": "hasPrice", "speed": "hasSpeed", "working days": "hasDays"}
LANDLINE_WORDS = ("landline", "dial tone", "handset", "home phone")
SPACES = {"finance": ("fi", "https://example.org/finance/"), "legal": ("legal", "https://example.org/legal/"), "telco": ("broadband", "https://example.org/broadband/")}
