"""Fixed values of retrieval and of the assistant: word lists only, no logic."""

#: Words that carry no meaning for retrieval.
STOPWORDS = """
a an and are as at be been by can could do does did for from has have how i if in is it its me my of on or our
should so than that the their them then there these they this to was we were what when where which who why will
with would you your about any all also into more most much not only per same such tell us please show give
""".split()

#: Phrases that mean the same; a question with one of a group is asked with the words of all.
SYNONYMS = (
    ("stockout", "out of stock", "ran out", "run out", "empty shelf", "zero stock"),
    ("reorder", "replenish", "replenishment", "restock", "order more"),
    ("sla", "delivery promise", "on time", "on-time", "late delivery", "delivery time", "15 minutes"),
    ("aov", "average order value", "basket value"),
    ("refund", "return", "money back", "reimburse"),
    ("promotion", "discount", "offer", "deal", "coupon"),
    ("cancellation", "cancel", "cancelled", "canceled"),
    ("forecast", "prediction", "predict", "demand forecast"),
    ("segment", "segmentation", "customer group", "cluster"),
    ("anomaly", "unusual", "spike", "outlier"),
    ("wape", "forecast error", "accuracy"),
    ("lead time", "supplier delivery", "delivery from supplier"),
    ("write-off", "write off", "damaged", "damage", "expired"),
    ("net revenue", "revenue", "sales value"),
    ("recommendation", "recommend", "suggest products"),
    ("lift", "confidence", "bought together", "basket rule", "affinity"),
)

#: The phrases by which a question names a tool's topic.
TOOL_PHRASES = {
    "inventory_overview": ("stock position", "inventory overview", "stock health", "stock status", "zero stock", "inventory status", "how is our stock", "stock situation"),
    "category_forecast": ("forecast", "expected demand", "demand next", "next 7 days", "next week", "expected sales", "predicted demand", "how many units will"),
    "top_forecast": ("most demanded", "highest demand", "in highest demand", "highest expected demand", "most in demand", "sell the most", "will sell most", "top selling next week", "biggest demand", "demand ranking"),
    "forecast_reliability": ("forecast reliability", "trust the forecast", "forecast accuracy", "reliable forecast", "how accurate is the forecast", "wape by category", "reliability"),
    "lost_sales": ("lost sales", "lost revenue", "cost of stockouts", "sales lost", "lost units", "stockouts cost"),
    "sales_overview": ("revenue", "net revenue", "sales performance", "gmv", "aov", "average order value", "completed orders", "how are we selling", "how did we sell", "cancellation rate", "sales"),
    "top_products": ("top products", "best selling", "best-selling", "top selling", "best sellers", "top sellers", "top skus by revenue", "highest revenue products"),
    "delivery_overview": ("delivery performance", "on-time", "on time", "delivery time", "late deliveries", "failed deliveries", "deliveries", "delivery"),
    "cancellations": ("cancellations", "cancellation reasons", "why orders are cancelled", "cancelled orders", "cancellation"),
    "anomalies": ("anomaly", "anomalies", "spike", "spikes", "unusual", "payment failure", "payment failures", "outage", "outages"),
    "segments": ("segment", "segments", "customer groups", "customer segments", "who are our customers", "personas", "clusters"),
    "bought_with": ("bought with", "bought together", "buy with", "goes with", "purchased with", "pairs with"),
    "recommendation_accuracy": ("recommendation", "recommendations", "precision@10", "precision at 10"),
    "retention": ("retention", "lapsed", "churn", "at risk customers", "inactive customers", "win back", "active customers", "repeat rate", "cohort"),
    "promotions": ("promotion results", "promotions", "promotion", "uplift", "promo", "campaign results"),
    "pipeline_status": ("pipeline", "pipeline run", "pipeline runs", "last run", "run history", "failed runs", "run failed", "runs failed", "success rate", "pipeline status", "pipeline health"),
    "pipeline_rows": ("rows processed", "rows written", "rows loaded", "records processed", "row count", "row counts", "how many rows", "data volume", "rows rejected"),
    "data_quality": ("data quality", "clean rate", "quality checks", "dirty data", "data issues", "duplicates removed", "validation results"),
    "quarantine": ("quarantine", "quarantined", "rejected rows", "rejected records", "quarantine reasons"),
    "model_health": ("model registry", "model version", "model versions", "live models", "model health", "model performance", "models in production", "latest models"),
}

#: What a tool counts, for questions that ask how many.
MEASURES = {"pipeline_rows": ("row", "record"), "quarantine": ("row", "record"), "pipeline_status": ("run",), "model_health": ("model",)}

#: Words that ask for a rule, for a definition, for numbers, or about the tables themselves.
POLICY_CUES = (
    "policy", "policies", "should we", "should i", "should a", "should the", "what should", "rule", "rules", "allowed", "procedure", "guideline", "what do we do", "what to do", "what happens when", "what happens if", "can a", "can we", "can i", "must",
    "eligible", "eligibility", "how long", "timeline", "escalate", "escalation", "approve", "approval", "limit", "when should", "recommend doing", "what does policy", "according to policy",
)
DEFINITION_CUES = ("what does", "mean", "means", "how is", "how are", "how does", "what is a", "what is an")
DATA_CUES = ("which", "how many", "how much", "show", "list", "top", "give me", "current", "total", "compare", "number of", "count", "what was", "what were", "what is our", "what are our", "did we", "were there", "is there", "are there", "status", "overview")
TABLE_CUES = ("column", "columns", "schema", "grain", "lineage", "upstream", "downstream", "data type", "data types")
