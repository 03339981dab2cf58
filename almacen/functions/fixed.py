"""Fixed values that must equal the source ETL's for identical results.

Everything in this module is data, not logic: lists and thresholds that
the cleaning, dimension and segmentation steps compare against.
"""

# --- FIXED VALUES (must match the original ETL exactly) ---------------------

# Raw feed columns, in file order. Renamed by position during staging.
RAW_COLUMNS = [
    "Invoice", "StockCode", "Description", "Quantity",
    "InvoiceDate", "Price", "Customer ID", "Country",
]
STAGED_COLUMNS = [
    "invoice", "stock_code", "description", "quantity",
    "invoice_date", "price", "customer_id", "country",
]

# Timestamp layout of InvoiceDate.
INVOICE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Defaults for missing values.
UNKNOWN_CUSTOMER = "UNKNOWN"
NO_DESCRIPTION = "SIN DESCRIPCION"
DEFAULT_REGION = "Otros"

# Stock codes that are not real products (case-sensitive, no trimming).
SPECIAL_CODES = [
    "POST", "DOT", "M", "D", "C2", "AMAZONFEE", "C3",
    "BANK CHARGES", "PADS", "TEST001", "TEST002",
    "ADJUST", "ADJUST2", "m", "B", "CRUK", "S",
]

# Country -> region lookup (45 entries). Unmapped countries get DEFAULT_REGION.
REGIONS = {
    "United Kingdom": "Europa Occidental", "Germany": "Europa Occidental",
    "France": "Europa Occidental", "Netherlands": "Europa Occidental",
    "Belgium": "Europa Occidental", "Switzerland": "Europa Occidental",
    "Portugal": "Europa Occidental", "Spain": "Europa Occidental",
    "Austria": "Europa Occidental", "Luxembourg": "Europa Occidental",
    "EIRE": "Europa Occidental", "Norway": "Europa Nordica",
    "Sweden": "Europa Nordica", "Denmark": "Europa Nordica",
    "Finland": "Europa Nordica", "Iceland": "Europa Nordica",
    "Poland": "Europa del Este", "Czech Republic": "Europa del Este",
    "Lithuania": "Europa del Este", "Italy": "Europa del Sur",
    "Greece": "Europa del Sur", "Malta": "Europa del Sur",
    "Cyprus": "Europa del Sur", "USA": "America",
    "Canada": "America", "Brazil": "America",
    "Australia": "Oceania", "Japan": "Asia",
    "Singapore": "Asia", "Hong Kong": "Asia",
    "Thailand": "Asia", "Israel": "Oriente Medio",
    "Lebanon": "Oriente Medio", "Bahrain": "Oriente Medio",
    "Saudi Arabia": "Oriente Medio", "United Arab Emirates": "Oriente Medio",
    "South Africa": "Africa", "Nigeria": "Africa",
    "RSA": "Africa", "Channel Islands": "Otros",
    "European Community": "Otros", "Unspecified": "Otros",
    "Bermuda": "America", "West Indies": "America", "Korea": "Asia",
}

# Customer segments by number of distinct non-cancelled invoices:
# 0 -> UNKNOWN, 1 -> NUEVO, 2..5 -> REGULAR, 6..15 -> FRECUENTE, >15 -> VIP.
SEGMENT_UNKNOWN = "UNKNOWN"
SEGMENT_NEW = "NUEVO"
SEGMENT_REGULAR = "REGULAR"
SEGMENT_FREQUENT = "FRECUENTE"
SEGMENT_VIP = "VIP"
SEGMENT_REGULAR_MAX = 5
SEGMENT_FREQUENT_MAX = 15

# Tokens the source's CSV reader (pandas defaults) turns into missing values.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Declared warehouse limits (column widths and numeric ranges).
NVARCHAR_WIDTHS = {
    "dim_fecha": {"mes_nombre": 20, "nombre_dia": 15},
    "dim_cliente": {"customer_id": 20, "country": 60, "segmento": 20},
    "dim_producto": {"stock_code": 20, "descripcion": 200},
    "dim_geografia": {"country": 60, "region": 40},
    "fact_ventas": {"invoice_number": 20},
}
DECIMAL_10_2_LIMIT = 10 ** 8      # |x| < 1e8 fits DECIMAL(10,2)
TINYINT_MAX = 255
SMALLINT_MAX = 32767

# --- end of fixed values ----------------------------------------------------

# RFM scoring (not stated by the source; our documented choice): score sum
# thresholds for the label, highest first.
RFM_LABELS = [
    (13, "Champions"),
    (10, "Loyal"),
    (7, "Potential"),
    (4, "At risk"),
]
RFM_LABEL_REST = "Lost"
RFM_BUCKETS = 5

# Office hours window used by the dashboard metric (hours 10..14 inclusive).
BUSINESS_HOURS = (10, 15)

# Days an order keeps a customer active (our choice).
ACTIVE_DAYS = 30

# Days without an order that end a purchase session (our choice).
SESSION_GAP_DAYS = 30
