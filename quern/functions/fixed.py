"""Values that results depend on."""

from __future__ import annotations

# Patterns of the record classifier, in the order in which they are given.
MONITORING = [
    r"^\[NR\]", r"HeartBeat", r"SQLJob[:\s]", r"FileCompare[:\s]", r"PerfCounter[:\s]", r"DiskFreeSpace", r"LowJourneyCount",
    r"Service not running", r"Ping\s+\w+", r"Filstorlek[:\s]", r"Replikeringskö", r"FolderSize[:\s]", r"CertificateCheck",
    r"DatabaseBackup", r"DatabaseIntegrityCheck", r"IndexOptimize", r"ReceiveQueueLength", r"SyncronizationsState", r"RabbitMQ",
    r"messages_ready", r"Queue messages", r"Failover cluster",
]
CONFIG = [
    r"infraändring", r"zonjustering", r"körlänk", r"polygon", r"hållplats.*flytt", r"servicefönster", r"maintenance",
    r"MAC.?adress", r"avinstallera", r"patchning", r"uppgradering",
]
ADMIN = [r"möte\b", r"meeting\b", r"prenumeration", r"fråga\b", r"stämmer följande", r"utbildning\b"]
FORWARD = [r"^(FW|Fwd|VB|SV|RE):\s"]

# Stop words.
STOP_WORDS = [
    "och", "att", "det", "som", "för", "med", "har", "kan", "inte", "den", "ett", "var", "från", "till", "ska", "vid", "nya", "alla", "efter",
    "när", "utan", "eller", "men", "här", "där", "dess", "hade", "hon", "han", "vara", "vill", "ser", "ang", "ärende", "ärenden", "ärendet",
    "detta", "dessa", "behöver", "blir", "borde", "bara", "sedan", "också", "redan", "mer", "mycket", "genom", "kunde", "skulle",
    "samma", "andra", "hela", "igen", "flera", "dock", "vad", "hur",
    "the", "and", "for", "with", "not", "this", "that", "from", "has", "was", "are", "have", "been", "will", "can", "new", "all", "about", "into",
    "just", "some", "than", "them", "then", "also", "only",
    "fwd", "fw", "re", "sv", "vb",
    "angående", "gäller", "hej", "tack", "mvh", "mailto", "ref", "service", "request", "incident", "problem", "fel", "fråga",
    "akut", "prio", "hög", "låg", "info", "information",
    "okänd", "test", "prod", "dev", "staging", "server", "system", "ärenderubrik", "felanmälan", "beställning",
    "standardklient", "produktion", "klient",
    "normal", "kritisk", "brådskande", "urgent", "high", "medium", "low", "critical", "öppen", "stängd", "löst", "closed", "open", "resolved",
    "used", "free", "less", "more", "like", "need", "please", "want", "regarding",
]

# Stop words of the suggestion of tags.
TAG_STOP_WORDS = [
    "och", "i", "att", "en", "ett", "det", "som", "på", "är", "av", "för",
    "med", "till", "den", "har", "inte", "om", "de", "vi", "kan", "var",
    "från", "så", "men", "alla", "ska", "här", "vid", "eller", "hur",
    "efter", "upp", "ut", "där", "in", "sig", "över", "under", "utan",
    "när", "vad", "mer", "man", "sin", "sina", "sedan", "mot",
    "nu", "bara", "än", "mycket", "också", "andra", "samma", "the",
    "and", "is", "in", "to", "of", "a", "for", "that", "with", "on",
]

# Action words; the first list is matched as words, the second as substrings.
ACTIONS = [
    "saknas", "fel", "fungerar inte", "funkar inte", "synlighet", "inloggning", "import", "export", "uppgradering", "integration",
    "konfiguration", "kraschar", "hänger", "timeout", "långsam", "trasig", "certifikat", "backup", "anslutning", "behörighet",
    "problem", "error", "failure", "missing", "broken", "nere", "nedlagd", "avbrott", "störning", "driftstörning",
]
TITLE_ACTIONS = [
    "saknas", "fel", "fungerar", "funkar", "problem", "trasig", "kraschar", "hänger", "timeout", "långsam", "nere", "avbrott",
    "inloggning", "behörighet", "import", "export", "uppgradering", "installation", "konfiguration", "migration", "byte",
    "missing", "error", "broken", "failed", "unavailable", "felanmälan", "störning", "driftstörning",
]

# Tags that only give a priority.
PRIORITY_TAG = r"(?i)^[0-9]+\.\s*(Normal|Hög|Låg|Kritisk|Medium|High|Low)"

# Aliases of query tokens.
ALIASES = {"semantisk": "semantic", "sökning": "search", "sokning": "search", "regel": "rule", "regler": "rules", "relaterad": "related", "meddelande": "message", "avvikelse": "deviation"}

# Cut-offs of clustering, merging, splitting, topics, entities, search and priority.
CLUSTER = {"similarity_threshold": 0.42, "min_cluster": 3, "target_min": 8, "target_max": 12}
MISSING_SHARE = 0.2
MERGE_CENTROID, MERGE_TOPICS, MERGE_SIZE, MERGE_KEPT_TOPICS = 0.75, 0.3, 15, 10
SPLIT_SIZE, SPLIT_SIMILARITY = 15, 0.45
TOPIC_SHARE, TOPIC_COUNT, PROPER_BOOST = 0.4, 5, 2.0
ENTITY_SHARE, ENTITY_LEAST_ROWS = 0.5, 5
LEXICAL_FLOOR, VECTOR_FLOOR = 0.05, 0.2
WEIGHTS = {"semantic": 0.4, "graph": 0.25, "trust": 0.2, "recency": 0.15}
UNKNOWN_AGE_DAYS = 3650.0
