"""Fixed dimension data.

Everything in this module is a FIXED VALUE that must equal the behaviour
being reproduced (format lists, event-type sets, label names, rule tables).
The tables are tiny and constant, so broadcasting them is size-bounded by
construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Document formats.
MAX_FILE_SIZE_BYTES = 52_428_800
DIRECT_PARSE_EXTS = [".txt", ".md", ".markdown", ".csv"]
FORMAT_TIERS = {
    "rich": [".pdf", ".docx", ".pptx"],
    "markup": [".md", ".markdown", ".html", ".htm", ".adoc", ".asciidoc", ".vtt"],
    "tabular": [".xlsx", ".xls", ".csv"],
    "image": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"],
    "audio": [".mp3", ".wav"],
}
TABULAR_ROUTE_EXTS = [".xlsx", ".xls", ".csv"]
DOCUMENT_TIMEOUT_S = 1800

# Layout labels -> element types.
LABEL_TO_TYPE = {
    "section_header": "Title",
    "title": "Title",
    "subtitle": "Title",
    "text": "NarrativeText",
    "paragraph": "NarrativeText",
    "caption": "NarrativeText",
    "footnote": "NarrativeText",
    "formula": "NarrativeText",
    "code": "NarrativeText",
    "list_item": "ListItem",
    "page_header": "Header",
    "page_footer": "Header",
    "table": "Table",
    "document_index": "Table",
    "picture": "Image",
    "chart": "Image",
}

# Run events.
LIFECYCLE_EVENTS = ["RUN_STARTED", "RUN_FINISHED", "RUN_ERROR"]
STEP_EVENTS = ["STEP_STARTED", "STEP_FINISHED", "STEP_ERROR"]
STATE_EVENTS = ["STATE_SNAPSHOT", "STATE_DELTA"]
TEXT_EVENTS = ["TEXT_MESSAGE_START", "TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_END"]
TOOL_EVENTS = ["TOOL_CALL_START", "TOOL_CALL_ARGS", "TOOL_CALL_END", "TOOL_CALL_RESULT"]
HITL_EVENTS = ["WAITING_FOR_INPUT", "WAITING_FOR_REVIEW", "REVIEW_COMPLETE"]
CUSTOM_EVENTS = ["CUSTOM", "RAW"]
TERMINAL_EVENTS = ["RUN_FINISHED", "RUN_ERROR"]
PAUSING_EVENTS = ["WAITING_FOR_INPUT", "WAITING_FOR_REVIEW"]

# Run statuses.
TERMINAL_STATUSES = ["COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT", "TIMEOUT"]
HITL_STATUSES = ["WAITING_FOR_REVIEW", "WAITING_FOR_INPUT"]
ENDED_STATUSES = ["COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT"]
RUN_TIMEOUT_S = 1800
REGISTRY_TTL_HOURS = 24

# Retry policy for parse attempts.
RETRY_WAIT_S = 30
MAX_ATTEMPTS = 3

# Slug / id patterns.
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SLUG_REF_PATTERN = r"\{\{[a-z0-9][a-z0-9_-]*"
UUID_REF_PATTERN = r"\{\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
FUNCTION_REF_PATTERN = r"\{\{[a-zA-Z_][a-zA-Z0-9_]*(?=\.)"
VAR_REF_PATTERN = r"\{\{([a-zA-Z0-9_-]+)\.([a-zA-Z0-9_.]+)\}\}"

# Node types (definition file spelling) and execution modes.
NODE_TYPES = [
    "plain_txt_input", "structured_input", "file_upload", "memory_file_url",
    "agent", "rag_agent", "llm_call", "structured_output", "retrieve",
    "document_extraction", "human_review", "api_consumption",
]
EXECUTION_MODES = ["INPUT", "OUTPUT", "MESSAGES", "FLOW"]
UNSUPPORTED_NODE_TYPES = ["document_extraction"]
OUTPUT_CHECK_EXEMPT_TYPES = ["STRUCTURED_INPUT", "STRUCTURED_OUTPUT"]
FIELD_DRIFT_IGNORED = ["name", "description", "metadata"]

# Retired config keys: (node type, field, message).
REMOVED_FIELDS = [
    ("llm_call", "topP", "LLM_CALL nodes no longer support topP. Remove this field."),
    ("structured_output", "extractionPrompt",
     "STRUCTURED_OUTPUT nodes no longer support extractionPrompt. Remove this field."),
    ("rag_agent", "disableRAG", "RAG_AGENT nodes no longer support disableRAG. Remove this field."),
    ("file_upload", "textExtraction",
     "FILE_UPLOAD nodes no longer support textExtraction. Remove this field."),
    ("file_upload", "extractTables",
     "FILE_UPLOAD nodes no longer support extractTables. Remove this field."),
    ("file_upload", "preserveFormatting",
     "FILE_UPLOAD nodes no longer support preserveFormatting. Remove this field."),
]
# Config model fields per node type (attribute names of the typed configs).
MODEL_FIELDS = {
    "plain_txt_input": ["placeholder"],
    "structured_input": ["schema_"],
    "file_upload": ["acceptedFormats", "maxFileSize", "saveToMemory"],
    "memory_file_url": ["path"],
    "agent": ["model", "temperature", "maxTokens", "tools", "agentId", "primaryInput",
              "system_prompt", "use_rlm", "web_tools_enabled", "max_iterations"],
    "rag_agent": ["agentId", "knowledgeBaseIds", "agent_name", "knowledge_base_names",
                  "primaryInput", "topK", "system_prompt"],
    "llm_call": ["model", "template", "system_prompt", "temperature", "maxTokens"],
    "structured_output": ["schema_", "model", "primaryInput", "system_prompt"],
    "retrieve": ["knowledgeBaseId", "knowledge_base_name", "knowledge_base_names", "topK",
                 "searchQuery", "scoreThreshold", "enableReranking", "includeMetadata"],
    "document_extraction": ["fields", "extractionMethod", "prompt", "extractTables", "extractImages"],
    "human_review": ["review_prompt", "timeoutMinutes", "allowApprove", "allowReject", "allowEdit"],
    "api_consumption": ["connectorId", "primaryInput", "maxRecursionDepth", "operationHint",
                        "timeoutSeconds", "saveToMemory", "memoryFilePath",
                        "responseVariableMappings", "headers", "callParams"],
}

# Config keys that never reach the service, per node type.
CLIENT_ONLY_FIELDS = {
    "AGENT": ["agent_name", "agentId", "primaryInput", "tools"],
    "RAG_AGENT": ["agent_name", "agentId", "knowledge_base_names", "knowledgeBaseIds", "primaryInput"],
    "RETRIEVE": ["knowledgeBaseId", "knowledge_base_name", "knowledge_base_names", "searchQuery", "scoreThreshold",
                 "enableReranking", "includeMetadata"],
    "STRUCTURED_OUTPUT": ["primaryInput"],
    "HUMAN_REVIEW": ["review_prompt"],
}
# Definition key -> service key, per node type.
SCHEMA_ALIASES = {
    "AGENT": {"model": "model_name", "maxTokens": "max_tokens", "saveToMemory": "save_to_memory",
              "memoryFilePath": "memory_file_path"},
    "RAG_AGENT": {"model": "model_name", "maxTokens": "max_tokens", "topK": "top_k_results",
                  "saveToMemory": "save_to_memory", "memoryFilePath": "memory_file_path"},
    "LLM_CALL": {"model": "model_name", "maxTokens": "max_tokens", "template": "system_prompt",
                 "saveToMemory": "save_to_memory", "memoryFilePath": "memory_file_path"},
    "RETRIEVE": {"topK": "top_k_results", "scoreThreshold": "similarity_threshold", "enableReranking": "enable_reranking",
                 "includeMetadata": "include_metadata", "saveToMemory": "save_to_memory", "memoryFilePath": "memory_file_path"},
    "STRUCTURED_OUTPUT": {"model": "model_name", "maxTokens": "max_tokens", "schema": "output_schema",
                          "saveToMemory": "save_to_memory", "memoryFilePath": "memory_file_path"},
    "HUMAN_REVIEW": {"timeoutMinutes": "timeout_minutes", "allowApprove": "allow_approve", "allowReject": "allow_reject",
                     "allowEdit": "allow_edit"},
    "API_CONSUMPTION": {"connectorId": "connector_id", "maxRecursionDepth": "max_recursion_depth",
                        "operationHint": "operation_hint", "timeoutSeconds": "timeout_seconds",
                        "saveToMemory": "save_to_memory", "memoryFilePath": "memory_file_path",
                        "responseVariableMappings": "response_variable_mappings"},
}
# Stored parameter key -> definition key (None: the same), per node type.
PARAMETER_FIELDS = {
    "PLAIN_TXT_INPUT": {"prompt": "placeholder"},
    "FILE_UPLOAD": {"acceptedFormats": None, "maxFileSize": None, "saveToMemory": None},
    "AGENT": {"agentId": None, "model": None, "primaryInput": None, "temperature": None, "maxTokens": None,
              "systemPrompt": "system_prompt", "use_rlm": None, "web_tools_enabled": None, "max_iterations": None,
              "saveToMemory": None, "memoryFilePath": None},
    "RAG_AGENT": {"agentId": None, "knowledgeBasesOverride": "knowledgeBaseIds", "primaryInput": None, "topK": None,
                  "systemPrompt": "system_prompt", "saveToMemory": None, "memoryFilePath": None},
    "LLM_CALL": {"model": None, "template": None, "system_prompt": None, "systemPrompt": "system_prompt",
                 "temperature": None, "maxTokens": None, "saveToMemory": None, "memoryFilePath": None},
    "RETRIEVE": {"knowledgeBaseId": None, "topK": None, "searchQuery": None, "scoreThreshold": None,
                 "saveToMemory": None, "memoryFilePath": None},
    "STRUCTURED_OUTPUT": {"primaryInput": None, "systemPrompt": "system_prompt", "saveToMemory": None, "memoryFilePath": None},
    "HUMAN_REVIEW": {"instructions": "review_prompt", "review_prompt": None, "timeoutMinutes": None,
                     "requireApproval": "allowApprove", "allowDataEditing": "allowEdit"},
    "DOCUMENT_EXTRACTION": {"extract_tables": "extractTables", "extract_images": "extractImages"},
}
# Stored config key -> definition key (None: the same), per node type.
CONFIG_FIELDS = {
    "PLAIN_TXT_INPUT": {"placeholder": None},
    "AGENT": {"model": None, "model_name": "model", "primaryInput": None, "temperature": None, "max_tokens": "maxTokens",
              "maxTokens": None, "tools": None, "agent_id": "agentId", "use_rlm": None, "web_tools_enabled": None,
              "max_iterations": None},
    "STRUCTURED_INPUT": {"schema": None},
    "STRUCTURED_OUTPUT": {"schema": None, "model": None},
    "RAG_AGENT": {"agent_id": "agentId", "knowledge_base_ids": "knowledgeBaseIds", "primaryInput": None},
    "RETRIEVE": {"enable_reranking": "enableReranking", "include_metadata": "includeMetadata",
                 "knowledge_base_id": "knowledgeBaseId", "knowledge_base_ids": "knowledgeBaseId"},
    "HUMAN_REVIEW": {"review_prompt": None, "timeout_minutes": "timeoutMinutes", "allow_approve": "allowApprove",
                     "allow_reject": "allowReject", "allow_edit": "allowEdit"},
    "DOCUMENT_EXTRACTION": {"fields": None, "extractionMethod": None, "prompt": None},
    "MEMORY_FILE_URL": {"path": None},
}
# Node type -> type name in stored parameters.
PARAMETER_TYPES = {
    "plain_txt_input": "plainTextInput", "structured_input": "formInput", "file_upload": "fileUpload", "agent": "agent",
    "rag_agent": "ragAgent", "llm_call": "llmPrompt", "structured_output": "structuredOutput", "retrieve": "retrieve",
    "document_extraction": "documentExtraction", "human_review": "humanReview", "memory_file_url": "memoryFileUrl",
    "api_consumption": "apiConsumption",
}
# Definition key -> stored parameter key and how its value is carried over: as it is, as a list ("list"), with
# slug references turned into node ids ("refs"), or as true ("true"). Of several keys for one parameter the first counts.
PARAMETER_RULES = {
    "plain_txt_input": [("placeholder", "prompt", "")],
    "file_upload": [("acceptedFormats", "acceptedFormats", ""), ("maxFileSize", "maxFileSize", ""), ("saveToMemory", "saveToMemory", "")],
    "agent": [("agent_id", "agentId", ""), ("model", "model", ""), ("temperature", "temperature", ""), ("maxTokens", "maxTokens", ""),
              ("system_prompt", "systemPrompt", ""), ("primaryInput", "primaryInput", "refs"), ("use_rlm", "use_rlm", ""),
              ("web_tools_enabled", "web_tools_enabled", ""), ("max_iterations", "max_iterations", ""),
              ("saveToMemory", "saveToMemory", ""), ("memoryFilePath", "memoryFilePath", "")],
    "rag_agent": [("agent_id", "agentId", ""), ("knowledge_base_ids", "knowledgeBasesOverride", ""), ("knowledge_base_id", "knowledgeBasesOverride", "list"),
                  ("model", "model", ""), ("temperature", "temperature", ""), ("maxTokens", "maxTokens", ""), ("system_prompt", "systemPrompt", ""),
                  ("topK", "topK", ""), ("primaryInput", "primaryInput", "refs"), ("saveToMemory", "saveToMemory", ""), ("memoryFilePath", "memoryFilePath", "")],
    "llm_call": [("model", "model", ""), ("temperature", "temperature", ""), ("maxTokens", "maxTokens", ""), ("system_prompt", "systemPrompt", ""),
                 ("template", "template", "refs"), ("saveToMemory", "saveToMemory", ""), ("memoryFilePath", "memoryFilePath", "")],
    "retrieve": [("knowledge_base_id", "knowledge_base_ids", "list"), ("knowledgeBaseId", "knowledge_base_ids", "list"),
                 ("knowledge_base_ids", "knowledge_base_ids", ""), ("topK", "topK", ""), ("scoreThreshold", "scoreThreshold", ""),
                 ("searchQuery", "searchQuery", "refs"), ("saveToMemory", "saveToMemory", ""), ("memoryFilePath", "memoryFilePath", "")],
    "human_review": [("review_prompt", "instructions", ""), ("timeoutMinutes", "timeoutMinutes", ""), ("allowApprove", "requireApproval", ""),
                     ("allowReject", "requireApproval", "true"), ("allowEdit", "allowDataEditing", "")],
    "document_extraction": [("extractTables", "extractTables", ""), ("extractImages", "extractImages", ""), ("fields", "fields", ""),
                            ("extractionMethod", "extractionMethod", ""), ("prompt", "prompt", "")],
    "structured_output": [("schema", "schema", ""), ("model", "model", ""), ("temperature", "temperature", ""), ("maxTokens", "maxTokens", ""),
                          ("system_prompt", "systemPrompt", ""), ("primaryInput", "primaryInput", "refs"), ("saveToMemory", "saveToMemory", ""),
                          ("memoryFilePath", "memoryFilePath", "")],
    "api_consumption": [("connectorId", "connectorId", ""), ("primaryInput", "primaryInput", "refs"), ("maxRecursionDepth", "maxRecursionDepth", ""),
                        ("operationHint", "operationHint", ""), ("timeoutSeconds", "timeoutSeconds", ""), ("saveToMemory", "saveToMemory", ""),
                        ("responseVariableMappings", "responseVariableMappings", ""), ("memoryFilePath", "memoryFilePath", "refs"),
                        ("headers", "headers", "refs"), ("callParams", "callParams", "refs")],
}
# Nodes without an output, nodes without an input, and defaults of a stored node.
NO_OUTPUT_TYPES = ["structured_output"]
NO_INPUT_TYPES = ["plain_txt_input", "structured_input", "file_upload"]
NODE_TIMEOUT_S = 30
NODE_RETRIES = 3
# References that are dropped when they are null, "" or [].
DEPENDENCY_FIELDS = ["agentId", "knowledgeBasesOverride", "knowledgeBaseId", "agent_id", "knowledge_base_id", "knowledge_base_ids"]
# Keys of stored records that only a canvas uses.
UI_FIELDS = ["type", "collapsed", "validationLevel", "validationMessages", "function_name"]

# Validation check names in report order.
CHECK_NAMES = [
    "YAML Syntax", "WDF Schema Conformance", "Graph Reachability", "Cycle Detection",
    "Variable References", "Unsupported Node Types", "Output Variable Paths",
    "Inactive Node Types", "Field Coverage", "Node Type Recognition", "Edge References",
    "Entry/Exit Points", "Node Config Validation",
]
# ------------------------------------------------------------ end fixed values


def format_tiers(spark: SparkSession) -> DataFrame:
    rows = [(ext, tier) for tier, exts in FORMAT_TIERS.items() for ext in exts]
    return spark.createDataFrame(rows, "ext string, tier string")


def ingestable_exts(spark: SparkSession) -> DataFrame:
    exts = sorted({e for exts in FORMAT_TIERS.values() for e in exts} | set(DIRECT_PARSE_EXTS))
    return spark.createDataFrame([(e,) for e in exts], "ext string")


def label_map_column():
    """``MAP<STRING,STRING>`` literal of layout label -> element type."""
    return F.create_map(*[F.lit(x) for kv in LABEL_TO_TYPE.items() for x in kv])


def event_category_map():
    pairs = []
    for cat, names in [("lifecycle", LIFECYCLE_EVENTS), ("step", STEP_EVENTS),
                       ("state", STATE_EVENTS), ("text", TEXT_EVENTS),
                       ("tool", TOOL_EVENTS), ("hitl", HITL_EVENTS),
                       ("custom", CUSTOM_EVENTS)]:
        pairs += [(n, cat) for n in names]
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])
