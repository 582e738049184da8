"""Word lists, patterns and thresholds that define the results.

All of these are fixed values: a different list gives different results, so
they are stated plainly, in order (order is precedence where rules are tried
one after another).
"""

# --- fixed values: whole-value patterns -----------------------------------
VALUE_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
NUMERIC_STRING_PATTERN = r"^\d+$"
DATE_PATTERNS = {
    "YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$",
    "MM/DD/YYYY": r"^\d{2}/\d{2}/\d{4}$",
    "MM-DD-YYYY": r"^\d{2}-\d{2}-\d{4}$",
}
PII_PATTERNS = ["email", "phone", "ssn", "credit_card"]

# --- fixed values: column-name tokens (substring tests) --------------------
PII_TOKENS = ["email", "phone", "ssn", "social", "address", "name"]
KEY_TOKENS = ["id", "_id", "key", "code", "number"]
FINANCIAL_TOKENS = ["amount", "price", "cost"]
TEMPORAL_TOKENS = ["date", "time"]
KEY_NAME_TOKENS = ["id", "_id", "key", "pk", "code", "number", "num"]
DESCRIPTIVE_NAMES = ["name", "description", "title"]

# --- fixed values: type buckets (substring tests on the type name) ---------
DATE_TYPE_TOKENS = ["date", "timestamp", "time"]
NUMERIC_TYPE_TOKENS = ["int", "bigint", "double", "float", "decimal", "numeric"]
INTEGER_FAMILY = ["int", "integer", "bigint", "smallint", "tinyint"]
STRING_FAMILY = ["varchar", "char", "text", "string"]

# --- fixed values: text placeholders ---------------------------------------
PLACEHOLDERS = ["null", "n/a", "na", "none", "unknown", "undefined", "-", "tbd", "todo"]

# --- fixed values: table types ---------------------------------------------
CLASS_DIMENSION_TOKENS = ["dim_", "dimension_", "_dim", "_lookup", "_ref", "_master"]
CLASS_FACT_TOKENS = ["fact_", "_fact", "trans_", "transaction_", "_events", "_log", "_activity"]
TYPE_DIMENSION_TOKENS = ["dim_", "dimension"]
TYPE_FACT_TOKENS = ["fact_", "facts"]
TYPE_AGGREGATE_TOKENS = ["agg_", "aggregate", "summary", "sum_", "rollup"]
COMMENT_AGGREGATE_WORDS = ["aggregate", "summary", "rollup"]
PERIOD_NAME_TOKENS = ["daily", "monthly", "weekly", "hourly", "by_", "rollup"]
MEASURE_NAME_TOKENS = ["count", "sum", "total", "amount", "revenue", "quantity", "avg", "min", "max"]
DATE_KEY_TOKENS = ["date_key", "time_key", "day_key", "month_key"]
DESCRIPTIVE_TOKENS = ["name", "description", "title", "type", "category", "status"]
FACT_WORDS = ["amount", "count", "sum", "total", "revenue", "cost", "price", "quantity", "value"]
DIMENSION_WORDS = ["name", "type", "category", "status", "description", "title"]

# --- fixed values: business domains, in order of precedence ----------------
TABLE_DOMAINS = {
    "customer": ["customer", "client", "user", "account", "contact", "person"],
    "sales": ["sale", "order", "transaction", "payment", "invoice", "revenue"],
    "product": ["product", "item", "inventory", "catalog", "sku", "goods"],
    "finance": ["finance", "accounting", "budget", "cost", "expense", "ledger"],
    "marketing": ["campaign", "marketing", "promotion", "advertisement", "lead"],
    "operations": ["operation", "process", "workflow", "task", "job", "activity"],
    "analytics": ["analytics", "metric", "kpi", "report", "dashboard", "summary"],
    "reference": ["lookup", "reference", "code", "type", "category", "status"],
}
FINDING_DOMAINS = {
    "customer": ["customer", "client", "user", "account"],
    "product": ["product", "item", "catalog", "inventory"],
    "sales": ["sales", "order", "transaction", "revenue"],
    "finance": ["finance", "payment", "billing", "invoice"],
    "marketing": ["marketing", "campaign", "promotion", "lead"],
    "operations": ["operations", "logistics", "supply", "fulfillment"],
    "hr": ["employee", "staff", "payroll", "hr"],
    "reference": ["reference", "lookup", "code", "type"],
}

# --- fixed values: tags read from finding texts, first rule that hits wins --
PRIORITY_RULES = [("high", ["high priority", "critical", "urgent"]),
                  ("low", ["low priority", "nice to have"])]
EFFORT_RULES = [("high", ["high effort", "complex", "significant"]),
                ("low", ["low effort", "simple", "quick"])]
SEVERITY_RULES = [("critical", ["critical", "severe", "major issue", "urgent"]),
                  ("high", ["high", "significant", "important"]),
                  ("low", ["low", "minor", "small"])]
IMPACT_RULES = [("high", ["business critical", "revenue impact", "compliance"]),
                ("medium", ["operational", "efficiency", "performance"])]
REMEDIATION_RULES = [("high", ["complex", "major effort", "significant work"]),
                     ("low", ["simple", "quick fix", "easy"])]
CONFIDENCE_RULES = [("high", ["high confidence", "certain", "clear"]),
                    ("low", ["low confidence", "uncertain", "unclear"])]
IMPORTANCE_RULES = [("critical", ["critical", "core", "essential", "key"]),
                    ("important", ["important", "significant", "major"])]
PERFORMANCE_RULES = [("high", ["significant", "50%", "2x", "dramatic"]),
                     ("medium", ["moderate", "20%", "30%", "noticeable"]),
                     ("low", ["minor", "10%", "slight", "small"])]
COMPLEXITY_RULES = [("high", ["complex", "difficult", "major", "significant effort"]),
                    ("medium", ["moderate", "medium", "some effort"]),
                    ("low", ["simple", "easy", "straightforward", "quick"])]

# --- fixed values: section-title categories, first rule that hits wins -----
MODELING_CATEGORIES = [
    ("dimensional_modeling", ["dimensional", "fact", "dimension"]),
    ("schema_design", ["schema", "design"]),
    ("partitioning", ["partition"]),
    ("indexing", ["index"]),
    ("performance", ["performance", "optimization"]),
    ("data_quality", ["quality"]),
    ("governance", ["governance", "security"]),
    ("normalization", ["normalization"]),
]
DISCOVERY_CATEGORIES = [
    ("asset_catalog", ["catalog", "asset"]),
    ("business_context", ["business", "context"]),
    ("relationship_mapping", ["relationship", "mapping"]),
    ("usage_patterns", ["access", "usage"]),
    ("domain_classification", ["domain", "classification"]),
]
ANALYSIS_CATEGORIES = [
    ("data_quality", ["quality"]),
    ("pattern_recognition", ["pattern", "trend"]),
    ("statistical_analysis", ["statistical", "distribution"]),
    ("data_profiling", ["profiling"]),
    ("business_impact", ["business", "impact"]),
]
OPTIMIZATION_CATEGORIES = [
    ("partitioning", ["partition"]),
    ("indexing", ["index"]),
    ("storage_optimization", ["compress", "format"]),
    ("data_layout", ["cluster", "bucket"]),
    ("query_optimization", ["query"]),
    ("caching", ["cache", "memory"]),
]

# --- fixed values: scores ----------------------------------------------------
SEVERITY_SCORES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
IMPACT_SCORES = {"high": 3, "medium": 2, "low": 1}
PRIORITY_SCORES = {"critical": 5, "high": 4, "medium": 3, "low": 2}
STAGE_WEIGHTS = {"discovery": 0.8, "analysis": 1.0, "modeling": 0.9, "optimization": 1.1}
PRIORITY_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
KEYWORD_STOPLIST = ["the", "and", "for", "with", "this", "that", "should", "could", "would"]

# --- fixed values: DDL words -------------------------------------------------
DDL_FORMATS = ["PARQUET", "ORC", "AVRO", "JSON", "CSV", "TEXTFILE", "RCFILE", "SEQUENCEFILE"]
DDL_COMPRESSIONS = ["GZIP", "SNAPPY", "LZO", "BZIP2", "DEFLATE", "LZ4"]
DDL_COMPRESSED_WORDS = ["PARQUET", "ORC", "GZIP", "SNAPPY"]

# --- fixed values: partitions and business columns ---------------------------
DATE_PARTITION_TOKENS = ["date", "dt", "day", "time"]
PARTITION_LIKE_TOKENS = ["date_key", "partition", "dt", "year", "month", "day"]
CHURNED_STATES = ["cancelled", "churned", "expired", "inactive"]
START_DATE_TOKENS = ["created", "start", "date"]
END_DATE_TOKENS = ["end", "cancel", "churn", "terminated"]
METRIC_CHANNEL_TOKENS = ["channel", "source", "platform"]
CHANNEL_TOKENS = ["channel", "source", "platform", "campaign", "medium"]
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
