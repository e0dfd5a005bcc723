"""Schemas and the fixed values that results must agree on."""

from __future__ import annotations

from pyspark.sql import types as T

# Invoice CSV columns, in file order.
INVOICE_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                   "UnitPrice", "CustomerID", "Country"]

INVOICE_CSV_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.StringType()),   # parsed strictly after the read
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])

CATEG_COLS = [f"categ_{i}" for i in range(5)]
FEATURE_COLS = ["mean"] + CATEG_COLS

# ---- fixed values (must equal the reference's for equal results) ----
# Segment name <-> cluster id.
SEGMENT_IDS = {
    "Champions": 0,
    "Loyal Customers": 1,
    "At Risk": 2,
    "Lost": 3,
    "Need Attention": 4,
    "Promising": 5,
    "Big Spenders": 6,
    "Standard": 7,
}
# Words never used as product keywords.
STOP_KEYWORDS = ["pink", "blue", "tag", "green", "orange"]
# Price band edges and labels.
PRICE_EDGES = [0, 1, 2, 3, 5, 10]
PRICE_BAND_LABELS = ["0<.<1", "1<.<2", "2<.<3", "3<.<5", "5<.<10", ".>10"]
# Product-group name parts.
PRICE_TAG_LOW = "低価格"
PRICE_TAG_MID = "中価格"
PRICE_TAG_PREMIUM = "プレミアム"
NAME_JOIN = " ＆ "
HIGH_RETURN_SUFFIX = "（返品多め）"
# Clean-up of generated group names: (pattern, replacement), applied in order.
GROUP_NAME_FIXES = [
    (r"^\s+|\s+$", ""),
    (r"\s*&\s*", NAME_JOIN),
    (r"(?i)\bAnd\b\.?$", ""),
    (r"^\s+|\s+$", ""),
    (r"\s{2,}", " "),
    (r"^[ \-_:;,./\\]+|[ \-_:;,./\\]+$", ""),
    ("Budget", PRICE_TAG_LOW),
    ("Mid-price", PRICE_TAG_MID),
    ("Premium", PRICE_TAG_PREMIUM),
    (r"\s*\(\s*", " ("),
    (r"\s*\)\s*", ")"),
]
# Share of customers below a Champion by spend alone.
CHAMPION_PERCENTILE = 0.95
# Segment stories, in rule order, then the default.
SEGMENT_STORIES = [
    "終極忠誠顧客，幾乎每天購買。請列為最高優先處理。",
    "高價值顧客，定期大量購買。建議提供專屬客服。",
    "VIP 顧客，購買頻率高且消費金額大，適合納入專屬活動。",
    "高頻率回購者，定期購買，為維持與擴大重點對象。",
    "偶發性但單次消費高，可能為大宗或企業客戶。",
    "持續性高額消費族群，穩定度高，適合建立長期合作關係。",
    "客單價較高但購買頻率中等，為中堅顧客群。",
    "經濟型顧客，價格導向，適合大眾促銷。",
    "標準型顧客，購買行為均衡，佔整體多數。",
]
# Model display names used in evaluation tables.
EVAL_NAMES_STAGE5 = ["SVC", "LR", "KNN", "DT", "RF", "ADA", "GB", "VOTE"]
EVAL_NAMES_STAGE6 = {
    "SVC": "Support Vector Machine",
    "LR": "Logistic Regression",
    "KNN": "k-Nearest Neighbors",
    "DT": "Decision Tree",
    "RF": "Random Forest",
    "GB": "Gradient Boosting",
    "VOTE": "Voting (RF+GB+KNN)",
}
EXPLAINED_MODELS = {"RF": "Random_Forest", "GB": "Gradient_Boosting",
                    "LR": "Logistic_Regression", "VOTE": "Voting_RF_GB_KNN"}
