"""Fixed schemas for the four raw e-commerce tables (customers, products, bookings, click stream).

Raw CSVs are read with these schemas instead of type inference. Timestamps arrive as ISO text
(``YYYY-MM-DDTHH:MM:SS.ffffffZ``) and are split by ``functions.scalar.split_iso_ts``.
"""

from pyspark.sql import types as T

CUSTOMER = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birthdate", T.DateType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_version", T.StringType()),
    T.StructField("home_location_lat", T.DoubleType()),
    T.StructField("home_location_long", T.DoubleType()),
    T.StructField("home_location", T.StringType()),
    T.StructField("home_country", T.StringType()),
    T.StructField("first_join_date", T.DateType()),
])

PRODUCT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("masterCategory", T.StringType()),
    T.StructField("subCategory", T.StringType()),
    T.StructField("articleType", T.StringType()),
    T.StructField("baseColour", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("usage", T.StringType()),
    T.StructField("productDisplayName", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("created_at", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("booking_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("product_metadata", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("payment_status", T.StringType()),
    T.StructField("promo_amount", T.DoubleType()),
    T.StructField("promo_code", T.StringType()),
    T.StructField("shipment_fee", T.DoubleType()),
    T.StructField("shipment_date_limit", T.StringType()),
    T.StructField("shipment_location_lat", T.DoubleType()),
    T.StructField("shipment_location_long", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
])

CLICK_STREAM = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("event_metadata", T.StringType()),
])

# Element type of the list-of-dict text in ``product_metadata``.
ITEM = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("item_price", T.DoubleType()),
])
ITEMS = T.ArrayType(ITEM)

RAW_SCHEMAS = {
    "customer": CUSTOMER,
    "product": PRODUCT,
    "transactions": TRANSACTIONS,
    "click_stream": CLICK_STREAM,
}
