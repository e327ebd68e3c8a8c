"""The eleven source tables: columns, key patterns, allowed values.

Fixed values: names, types, nullability, patterns and enumerations are the data
contract that incoming snapshots follow.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType, TimestampType

_DDL: dict[str, str] = {
    "customers": """
        source_customer_id STRING NOT NULL, first_name STRING, last_name STRING, email STRING,
        phone STRING, registration_date DATE NOT NULL, loyalty_tier STRING NOT NULL,
        preferred_channel STRING, home_city STRING, is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL""",
    "restaurants": """
        source_restaurant_id STRING NOT NULL, location_name STRING NOT NULL, city STRING NOT NULL,
        state_region STRING NOT NULL, postal_code STRING NOT NULL, seating_capacity INT NOT NULL,
        dining_type STRING NOT NULL, manager_name STRING, opening_date DATE NOT NULL,
        latitude DOUBLE, longitude DOUBLE, is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL""",
    "menu_categories": """
        source_category_id STRING NOT NULL, category_name STRING NOT NULL, description STRING,
        display_order INT NOT NULL, is_active BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL""",
    "menu_items": """
        source_menu_item_id STRING NOT NULL, source_category_id STRING NOT NULL,
        item_name STRING NOT NULL, description STRING, current_base_price DOUBLE NOT NULL,
        current_base_cost DOUBLE NOT NULL, prep_time_minutes INT NOT NULL,
        is_seasonal BOOLEAN NOT NULL, is_active BOOLEAN NOT NULL, spiciness_level INT NOT NULL,
        allergens STRING, created_at TIMESTAMP NOT NULL""",
    "pricing_history": """
        source_pricing_history_id STRING NOT NULL, source_menu_item_id STRING NOT NULL,
        source_restaurant_id STRING, base_price DOUBLE NOT NULL, base_cost DOUBLE NOT NULL,
        effective_from TIMESTAMP NOT NULL, effective_to TIMESTAMP, change_reason STRING NOT NULL,
        created_at TIMESTAMP NOT NULL""",
    "promotions": """
        source_promotion_id STRING NOT NULL, campaign_name STRING NOT NULL, promo_code STRING,
        discount_type STRING NOT NULL, discount_value DOUBLE NOT NULL, start_date DATE NOT NULL,
        end_date DATE NOT NULL, minimum_order_amount DOUBLE NOT NULL, source_category_id STRING,
        source_menu_item_id STRING, applicable_channel STRING, is_active BOOLEAN NOT NULL,
        is_misleading BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL""",
    "orders": """
        source_order_id STRING NOT NULL, source_restaurant_id STRING NOT NULL,
        source_customer_id STRING, order_timestamp TIMESTAMP NOT NULL,
        order_channel STRING NOT NULL, order_status STRING NOT NULL,
        subtotal_amount DOUBLE NOT NULL, discount_amount DOUBLE NOT NULL,
        tax_amount DOUBLE NOT NULL, tip_amount DOUBLE NOT NULL, total_amount DOUBLE NOT NULL,
        payment_method STRING NOT NULL, created_at TIMESTAMP NOT NULL""",
    "order_items": """
        source_order_item_id STRING NOT NULL, source_order_id STRING NOT NULL,
        source_menu_item_id STRING NOT NULL, quantity INT NOT NULL,
        unit_price_at_sale DOUBLE NOT NULL, unit_cost_at_sale DOUBLE NOT NULL,
        line_discount DOUBLE NOT NULL, source_promotion_id STRING,
        line_net_revenue DOUBLE NOT NULL, line_contribution_margin DOUBLE NOT NULL,
        special_instructions STRING, created_at TIMESTAMP NOT NULL""",
    "ratings": """
        source_rating_id STRING NOT NULL, source_restaurant_id STRING NOT NULL,
        source_order_id STRING, source_customer_id STRING, source_menu_item_id STRING,
        rating_score INT NOT NULL, food_rating INT, service_rating INT, ambiance_rating INT,
        review_text STRING, rating_timestamp TIMESTAMP NOT NULL,
        is_verified_purchase BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL""",
    "inventory": """
        source_inventory_id STRING NOT NULL, source_restaurant_id STRING NOT NULL,
        ingredient_name STRING NOT NULL, ingredient_category STRING NOT NULL,
        current_stock_quantity DOUBLE NOT NULL, unit_of_measure STRING NOT NULL,
        reorder_threshold DOUBLE NOT NULL, reorder_quantity DOUBLE NOT NULL,
        unit_purchase_cost DOUBLE NOT NULL, last_restock_date DATE, created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL""",
    "wastage": """
        source_wastage_id STRING NOT NULL, source_restaurant_id STRING NOT NULL,
        source_menu_item_id STRING, ingredient_name STRING, wastage_timestamp TIMESTAMP NOT NULL,
        quantity_lost DOUBLE NOT NULL, unit_of_measure STRING NOT NULL,
        cost_loss_amount DOUBLE NOT NULL, wastage_reason STRING NOT NULL, reported_by STRING,
        created_at TIMESTAMP NOT NULL""",
}

TABLES: tuple[str, ...] = tuple(_DDL)

KEYS: dict[str, str] = {
    "customers": "source_customer_id",
    "restaurants": "source_restaurant_id",
    "menu_categories": "source_category_id",
    "menu_items": "source_menu_item_id",
    "pricing_history": "source_pricing_history_id",
    "promotions": "source_promotion_id",
    "orders": "source_order_id",
    "order_items": "source_order_item_id",
    "ratings": "source_rating_id",
    "inventory": "source_inventory_id",
    "wastage": "source_wastage_id",
}

KEY_PATTERNS: dict[str, str] = {
    "customers": r"^CUST-\d{8}$",
    "restaurants": r"^REST-\d{4}$",
    "menu_categories": r"^CAT-\d{3}$",
    "menu_items": r"^DISH-\d{4}$",
    "pricing_history": r"^PRC-\d{6}$",
    "promotions": r"^PROMO-\d{4}$",
    "orders": r"^ORD-\d{8}$",
    "order_items": r"^ITEM-\d{8}$",
    "ratings": r"^RAT-\d{8}$",
    "inventory": r"^INV-REST\d{2}-\d{4}$",
    "wastage": r"^WASTE-\d{8}$",
}

ALLOWED_VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("customers", "loyalty_tier"): ("Bronze", "Silver", "Gold", "Platinum", "None"),
    ("restaurants", "dining_type"): (
        "Fast Casual", "Casual Dining", "Fine Dining", "Express Kiosk",
    ),
    ("orders", "order_channel"): (
        "Dine-in", "Takeaway", "Delivery Direct", "Delivery Aggregator",
    ),
    ("orders", "order_status"): ("Completed", "Cancelled", "Refunded", "Voided"),
    ("orders", "payment_method"): (
        "Credit Card", "Debit Card", "Cash", "Digital Wallet", "Gift Card",
    ),
    ("promotions", "discount_type"): (
        "Percentage", "Fixed Amount", "Buy One Get One", "Combo Bundle",
    ),
    ("menu_categories", "category_name"): (
        "Appetizers", "Entrees", "Seafood Specialties", "Pasta & Noodles",
        "Sandwiches & Burgers", "Side Dishes", "Desserts", "Non-Alcoholic Beverages",
        "Bar & Cocktails", "Chef Specials",
    ),
    ("inventory", "ingredient_category"): (
        "Produce", "Meat & Poultry", "Dairy", "Dry Goods", "Beverage Supplies", "Packaging",
    ),
    ("inventory", "unit_of_measure"): ("kg", "g", "L", "ml", "units", "boxes"),
    ("wastage", "unit_of_measure"): ("kg", "g", "L", "ml", "units", "boxes"),
    ("wastage", "wastage_reason"): (
        "Expired", "Over-preparation", "Cooking Error", "Equipment Failure",
        "Customer Returned", "Spillage",
    ),
}


def table_schema(name: str) -> StructType:
    """Schema of one source table; needs a running session to parse the DDL."""
    if name not in _DDL:
        raise KeyError(f"unknown table {name!r}; known tables: {', '.join(TABLES)}")
    return StructType.fromDDL(_DDL[name])


def all_schemas() -> dict[str, StructType]:
    return {name: table_schema(name) for name in TABLES}


def quarantine_schema(name: str) -> StructType:
    extra = [
        StructField("quarantine_reason", StringType()),
        StructField("quarantined_at", TimestampType()),
    ]
    return StructType(table_schema(name).fields + extra)
