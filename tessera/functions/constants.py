"""Fixed values that must equal the reference's for the same results.

Everything in this module is data, stated plainly in natural order: domain
packs, keyword lists, value maps, stopwords, lexicons, expectation tables,
KPI rule thresholds. Operators turn them into small static DataFrames or
literal expressions.
"""

# ---------------------------------------------------------------- fixed values
# Domain packs: expected columns, KPIs and expected features per domain.
DOMAIN_PACKS = {
    "logistics": {
        "kpis": ["SLA_pct", "TransitTime_avg", "RTO_pct", "FAS_pct", "NDR_pct"],
        "expected_columns": ["shipment_id", "order_id", "carrier", "origin", "destination",
                             "pickup_date", "delivery_date", "status", "transit_time", "dwell_time"],
        "expected_features": ["transit_time", "dwell_time", "sla_flag", "rto_flag", "fas_flag"],
    },
    "healthcare": {
        "kpis": ["BedOccupancy_pct", "AvgLOS_days", "Readmission_30d_pct", "ProcedureSuccess_pct"],
        "expected_columns": ["patient_id", "admission_ts", "discharge_ts", "department",
                             "diagnosis", "procedure", "los_days", "age", "gender"],
        "expected_features": ["los_days", "age_group", "icd_chapter"],
    },
    "emarketing": {
        "kpis": ["CTR_pct", "Conversion_pct", "CAC", "ROAS"],
        "expected_columns": ["campaign_id", "date", "channel", "spend", "impressions",
                             "clicks", "conversions", "start_date", "end_date"],
        "expected_features": ["spend", "impressions", "clicks", "ctr", "conversion_flag"],
    },
    "retail": {
        "kpis": ["GMV", "AOV", "CartAbandon_pct", "Return_pct"],
        "expected_columns": ["order_id", "customer_id", "order_date", "product_id",
                             "quantity", "price", "payment_method", "return_flag"],
        "expected_features": ["order_value", "basket_size", "return_flag", "seasonality_bucket"],
    },
    "finance": {
        "kpis": ["NPL_pct", "ROI_pct", "Liquidity_Ratio", "Default_pct"],
        "expected_columns": ["account_id", "customer_id", "account_type", "balance",
                             "open_date", "currency", "interest_rate", "default_flag"],
        "expected_features": ["loan_duration_days", "interest_yield", "overdue_flag"],
    },
}

# Keyword domain detection (column-name fragments), scored in this order.
DOMAIN_KEYWORDS = {
    "healthcare": ["patient", "appointment", "medical", "diagnosis", "treatment", "age",
                   "gender", "hospital", "clinic"],
    "logistics": ["shipment", "delivery", "transit", "warehouse", "order", "tracking",
                  "shipping", "logistics"],
    "retail": ["sales", "product", "customer", "order", "price", "revenue", "inventory", "sku"],
}

# Compatibility thresholds (match share of expected columns).
DOMAIN_OK = 0.70
DOMAIN_WARN = 0.30
