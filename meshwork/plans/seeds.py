"""Seed tables: fixed values that must equal the reference's for equal
results. They are small metadata tables, created with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column-name patterns that mark personal data (checked in
# this order; the first match gives the pattern number).
PII_PATTERNS = (
    r"(?i)(customer.*id|client.*id|user.*id)",
    r"(?i)(name|first.?name|last.?name|full.?name)",
    r"(?i)(email|e.?mail|mail)",
    r"(?i)(phone|telephone|mobile|cell)",
    r"(?i)(address|street|city|zip|postal)",
    r"(?i)(ssn|social.?security|national.?id|passport)",
    r"(?i)(birth|dob|date.?of.?birth|age)",
    r"(?i)(credit.?card|card.?number|cvv|expiry)",
    r"(?i)(salary|income|compensation|wage)",
)

# Default roles, privileged roles and access levels.
DEFAULT_ROLES = ("analyst", "manager", "data_engineer")
PRIVILEGED_ROLES = ("manager", "data_engineer")

# The global governance rules (id, name, description,
# severity, scope).
GLOBAL_RULES = (
    ("G001", "Data Contract Required", "Every data product must have a data contract", "error", "global"),
    ("G002", "PII Detection", "PII columns must be identified and access-restricted", "warning", "global"),
    ("G003", "Minimum Quality Score", "Data products must have quality score >= 70/100", "warning", "global"),
    ("G004", "Schema Documentation", "All columns must have descriptions in the contract", "info", "global"),
    ("G005", "Owner Assignment", "Every data product must have a designated owner", "error", "global"),
    ("G006", "No Dangerous Queries", "Generated queries must not contain DROP, DELETE, UPDATE, INSERT, DETACH DELETE, SET, REMOVE", "error", "global"),
)

# The default business glossary (term, definition, synonyms,
# related columns, domain, category), in the reference's order.
GLOSSARY = (
    ("Churn Rate", "Percentage of customers who left the company",
     ["attrition rate", "taux de churn", "taux d'attrition"], ["Churn"], "customer", "metric"),
    ("Customer Lifetime Value", "Total revenue generated by a customer",
     ["CLV", "CLTV", "valeur client"], ["TotalCharges", "tenure", "MonthlyCharges"], "revenue", "metric"),
    ("ARPU", "Average Revenue Per User — monthly charges averaged across customers",
     ["revenu moyen par utilisateur", "average revenue"], ["MonthlyCharges"], "revenue", "metric"),
    ("Contract Type", "The duration commitment of the customer's subscription",
     ["type de contrat", "subscription plan", "engagement"], ["Contract"], "product", "dimension"),
    ("Service Bundle", "Combination of services a customer subscribes to",
     ["bouquet de services", "service package"],
     ["PhoneService", "InternetService", "OnlineSecurity", "OnlineBackup",
      "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"], "product", "dimension"),
    ("Customer Tenure", "How long a customer has been with the company, in months",
     ["ancienneté", "durée d'abonnement", "customer age"], ["tenure"], "customer", "measure"),
    ("Senior Customer", "A customer aged 65 or older",
     ["client senior", "senior citizen", "elderly customer"], ["SeniorCitizen"], "customer", "dimension"),
)

DEFAULT_ANNOTATED_PRODUCT = "telco_churn_with_all_feedback"

# The default column annotations (column, business name,
# description, semantic type, sensitivity, aggregation hint, format hint);
# business domain is 'general' for all.
ANNOTATIONS = (
    ("customerID", "Customer ID", "Unique identifier for each customer", "identifier", "restricted", "", ""),
    ("gender", "Gender", "Customer gender (Male/Female)", "dimension", "public", "count", ""),
    ("SeniorCitizen", "Senior Citizen Status", "Whether the customer is a senior citizen (1=Yes, 0=No)", "dimension", "public", "", "boolean"),
    ("Partner", "Has Partner", "Whether the customer has a partner", "dimension", "public", "", ""),
    ("Dependents", "Has Dependents", "Whether the customer has dependents", "dimension", "public", "", ""),
    ("tenure", "Customer Tenure", "Number of months the customer has stayed with the company", "measure", "public", "avg", "months"),
    ("PhoneService", "Phone Service", "Whether the customer has phone service", "dimension", "public", "", ""),
    ("MultipleLines", "Multiple Lines", "Whether the customer has multiple phone lines", "dimension", "public", "", ""),
    ("InternetService", "Internet Service Type", "Customer's internet service provider (DSL, Fiber optic, No)", "dimension", "public", "", ""),
    ("OnlineSecurity", "Online Security Service", "Whether the customer has online security add-on", "dimension", "public", "", ""),
    ("OnlineBackup", "Online Backup Service", "Whether the customer has online backup add-on", "dimension", "public", "", ""),
    ("DeviceProtection", "Device Protection Service", "Whether the customer has device protection add-on", "dimension", "public", "", ""),
    ("TechSupport", "Tech Support Service", "Whether the customer has tech support add-on", "dimension", "public", "", ""),
    ("StreamingTV", "Streaming TV Service", "Whether the customer has streaming TV add-on", "dimension", "public", "", ""),
    ("StreamingMovies", "Streaming Movies Service", "Whether the customer has streaming movies add-on", "dimension", "public", "", ""),
    ("Contract", "Contract Type", "Type of contract: Month-to-month, One year, Two year", "dimension", "public", "", ""),
    ("PaperlessBilling", "Paperless Billing", "Whether the customer uses paperless billing", "dimension", "public", "", ""),
    ("PaymentMethod", "Payment Method", "How the customer pays: Electronic check, Mailed check, Bank transfer, Credit card", "dimension", "public", "", ""),
    ("MonthlyCharges", "Monthly Charges", "Amount charged to the customer monthly", "measure", "public", "avg", "currency"),
    ("TotalCharges", "Total Charges", "Total amount charged to the customer (stored as text, cast to DOUBLE for calculations)", "measure", "public", "sum", "currency"),
    ("Churn", "Customer Churn", "Whether the customer left the company (Yes/No). Key target variable.", "measure", "public", "count", "category"),
    ("PromptInput", "Prompt Input", "Generated prompt input for AI analysis", "attribute", "internal", "", ""),
    ("CustomerFeedback", "Customer Feedback", "Free-text customer feedback and comments", "attribute", "internal", "", ""),
)

GLOSSARY_SCHEMA = ("term_order int, term string, definition string, "
                   "synonyms array<string>, related_columns array<string>, "
                   "domain string, category string")
ANNOTATION_SCHEMA = ("product string, column_name string, business_name string, "
                     "description string, semantic_type string, business_domain string, "
                     "sensitivity string, aggregation_hint string, format_hint string")
RULE_SCHEMA = ("rule_id string, name string, description string, severity string, "
               "scope string, domain string")


def glossary(spark: SparkSession, extra=()) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(list(GLOSSARY) + list(extra))]
    return spark.createDataFrame(rows, GLOSSARY_SCHEMA)


def annotations(spark: SparkSession,
                product: str = DEFAULT_ANNOTATED_PRODUCT) -> DataFrame:
    rows = [(product, c, b, d, st, "general", se, ag, fm)
            for c, b, d, st, se, ag, fm in ANNOTATIONS]
    return spark.createDataFrame(rows, ANNOTATION_SCHEMA)


def rules(spark: SparkSession, domain_rules=()) -> DataFrame:
    """Global rules plus domain rules given as (domain, id, name,
    description, severity); domain rules are stored and counted only."""
    rows = [(*r, None) for r in GLOBAL_RULES]
    rows += [(rid, name, desc, sev, "domain", dom)
             for dom, rid, name, desc, sev in domain_rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def pii_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(PII_PATTERNS)],
                                 "pattern_id int, pattern string")
