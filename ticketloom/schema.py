"""Column types of the tables and the allowed values of the enum columns."""

from __future__ import annotations

# Enum members, in display order
TICKET_STATUSES = ("new", "in_progress", "awaiting_review", "resolved")
CATEGORIES = ("order_status", "refund_request", "damaged_item", "delivery_delay", "product_question", "cancellation")
URGENCIES = ("low", "medium", "high")
ORDER_STATUSES = ("processing", "shipped", "delivered", "delayed", "cancelled")
STEPS = ("triage", "knowledge", "order_lookup", "draft", "escalation")
CHANNELS = ("staff", "contact_form")
DOCUMENT_STATUSES = ("processing", "ready", "failed")
MODELS = ("category_classifier", "urgency_classifier")

# Served thresholds
MIN_CONFIDENCE = 0.6
REFUND_THRESHOLD = 100.0
SECTION_TOKENS = 300
MAX_SECTIONS = 400
MAX_FILE_BYTES = 5 * 1024 * 1024
TOP_K = 3

EVAL_CSV = "text string, category string, urgency string"
KB_SEED_JSON = "title string, categories array<string>, content string"
CORRECTIONS = (
    "ticket_id string, text string, category string, urgency string, predicted_category string, "
    "predicted_urgency string, category_model_version string, urgency_model_version string, "
    "corrected_by string, corrected_at string"
)
CORPUS = "text string, category string, source string, `group` string, split string"
EMPTY_LABEL_ROWS = "text string, label string"
