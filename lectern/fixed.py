"""Fixed values of the data contract.

Everything in this module is a value that has to be exactly this for results to agree with
existing corpora and models: label sets (their order is the class index), mapping tables,
term lists, thresholds, templates. Nothing here is logic.
"""

from __future__ import annotations

# --- label dimensions ("heads"); the order of labels is the class index -----------------
HEADS = ("nivel_tecnico", "urgencia", "emocion", "dominio")

LABELS = {
    "nivel_tecnico": ("principiante", "intermedio", "avanzado"),
    "urgencia": ("baja", "media", "alta"),
    "emocion": (
        "frustracion", "confusion", "curiosidad", "ansiedad", "motivacion",
        "abrumado", "confiado", "desesperado", "neutral",
    ),
    "dominio": (
        "backend", "frontend", "bases_de_datos", "movil", "devops",
        "data_science", "sistemas_seguridad", "general",
    ),
}

# label used when a supervised row carries a value outside the label set
HEAD_DEFAULT = {
    "nivel_tecnico": "principiante",
    "urgencia": "media",
    "emocion": "neutral",
    "dominio": "general",
}

HEAD_TITLES = {
    "nivel_tecnico": "Nivel tecnico",
    "urgencia": "Urgencia",
    "emocion": "Emocion",
    "dominio": "Dominio",
}

IGNORE_INDEX = -100
PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1
MAX_LEN = 160
MIN_FREQ, MAX_VOCAB = 2, 40_000

# --- emotion source: ids, names, mapping, priority --------------------------------------
EMOTION_IDS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)

EMOTION_MAP = {
    "anger": "frustracion",
    "annoyance": "frustracion",
    "disapproval": "frustracion",
    "confusion": "confusion",
    "curiosity": "curiosidad",
    "interest": "curiosidad",
    "desire": "curiosidad",
    "nervousness": "ansiedad",
    "fear": "ansiedad",
    "approval": "confiado",
    "pride": "confiado",
    "admiration": "motivacion",
    "excitement": "motivacion",
    "joy": "motivacion",
    "love": "motivacion",
    "optimism": "motivacion",
    "gratitude": "motivacion",
    "surprise": "abrumado",
    "realization": "abrumado",
    "sadness": "desesperado",
    "disappointment": "desesperado",
    "grief": "desesperado",
    "remorse": "desesperado",
    "embarrassment": "desesperado",
    "neutral": "neutral",
    "caring": "neutral",
    "amusement": "motivacion",
    "disgust": "frustracion",
    "relief": "motivacion",
}

EMOTION_PRIORITY = (
    "desesperado", "frustracion", "ansiedad", "abrumado", "confusion",
    "neutral", "curiosidad", "confiado", "motivacion",
)

# --- question source: tags, raw domains, quotas -----------------------------------------
TAG_DOMAIN = {
    "python": "backend", "javascript": "backend", "java": "backend", "php": "backend",
    "c#": "backend", "node.js": "backend", "spring": "backend", "spring-boot": "backend",
    "laravel": "backend", "go": "backend", "rust": "backend", "ruby": "backend",
    "react": "frontend", "vue.js": "frontend", "angular": "frontend", "css": "frontend",
    "html": "frontend", "svelte": "frontend", "nextjs": "frontend",
    "sql": "bases_de_datos", "mysql": "bases_de_datos", "postgresql": "bases_de_datos",
    "mongodb": "bases_de_datos", "redis": "bases_de_datos",
    "docker": "devops", "kubernetes": "devops", "aws": "devops", "gcp": "devops",
    "nginx": "devops", "ci/cd": "devops",
    "android": "movil", "ios": "movil", "flutter": "movil", "react-native": "movil",
    "swift": "movil", "kotlin": "movil",
    "pandas": "data_science", "numpy": "data_science", "scikit-learn": "data_science",
    "tensorflow": "data_science", "pytorch": "data_science",
    "sorting": "algoritmos", "algorithms": "algoritmos", "data-structures": "algoritmos",
    "recursion": "algoritmos", "graph-theory": "algoritmos",
    "security": "seguridad", "authentication": "seguridad", "encryption": "seguridad",
    "oauth": "seguridad", "jwt": "seguridad", "xss": "seguridad", "csrf": "seguridad",
    "tls": "seguridad", "penetration-testing": "seguridad",
    "os": "sistemas", "linux": "sistemas", "bash": "sistemas", "posix": "sistemas",
    "filesystem": "sistemas", "memory": "sistemas", "concurrency": "sistemas",
    "threads": "sistemas", "process": "sistemas",
    "design-patterns": "ingenieria_software", "testing": "ingenieria_software",
    "tdd": "ingenieria_software", "junit": "ingenieria_software",
    "refactoring": "ingenieria_software", "architecture": "ingenieria_software",
    "solid": "ingenieria_software",
    "git": "general", "typescript": "general",
}

DOMAIN_QUOTA = {
    "default": {
        "backend": 44, "frontend": 34, "bases_de_datos": 22, "devops": 22, "movil": 18,
        "data_science": 18, "algoritmos": 28, "seguridad": 26, "sistemas": 24,
        "ingenieria_software": 26, "general": 0,
    },
    "aggressive": {
        "backend": 36, "frontend": 28, "bases_de_datos": 22, "devops": 22, "movil": 18,
        "data_science": 32, "algoritmos": 45, "seguridad": 42, "sistemas": 38,
        "ingenieria_software": 40, "general": 0,
    },
}

DOMAIN_FINAL = {
    "backend": "backend",
    "frontend": "frontend",
    "bases_de_datos": "bases_de_datos",
    "movil": "movil",
    "devops": "devops",
    "data_science": "data_science",
    "seguridad": "sistemas_seguridad",
    "sistemas": "sistemas_seguridad",
    "sistemas_seguridad": "sistemas_seguridad",
    "algoritmos": "general",
    "ingenieria_software": "general",
    "general": "general",
}

# --- term lists -------------------------------------------------------------------------
URGENCY_TERMS = (
    "urgente", "ayuda", "bloqueado", "desesperado", "deadline", "entrega", "examen", "error",
)
ADVANCED_TERMS = (
    "complejidad", "big o", "optimiz", "concurrencia", "arquitectura", "patrones",
    "rendimiento", "escalabilidad",
)
ADVANCED_TAGS = ("rust", "go", "kubernetes", "concurrency", "algorithms")

URGENCY_STRONG = (
    "urgente", "bloqueado", "bloqueada", "bloqueo", "desesperado", "desesperada",
    "desesperacion", "deadline", "entrega", "examen", "contrarreloj",
)
URGENCY_WEAK = ("ayuda", "auxilio", "error", "no funciona", "no me funciona", "falla")
ADVANCED_STRONG = (
    "complejidad", "big o", "optimizacion", "optimizar", "optimizado", "concurrencia",
    "arquitectura", "escalabilidad", "latencia", "throughput",
)
ADVANCED_WEAK = ("patrones", "rendimiento", "profil", "benchmark")
ADVANCED_HINT_TAGS = (
    "algorithms", "data-structures", "concurrency", "multithreading", "kubernetes", "rust", "go",
)
LOW_URGENCY_TERMS = (
    "curiosidad", "aprender", "tutorial", "concepto", "libro", "recomendacion", "empezar",
    "diferencia entre", "que es", "buenas practicas", "solo pregunto", "por saber",
)

# first matching group wins
EMOTION_RULES = (
    ("ansiedad", ("urgente", "examen", "entrega", "produccion", "producción", "deadline")),
    ("confusion", ("no entiendo", "confus", "perdid", "no se", "no sé")),
    ("frustracion", ("error", "no funciona", "falla", "frustr", "harto")),
    ("curiosidad", ("como funciona", "cómo funciona", "por que", "por qué", "diferencia")),
    ("motivacion", ("gracias", "logre", "logré", "funciono", "funcionó")),
)

# --- sources and thresholds -------------------------------------------------------------
QUESTION_SOURCE = "so_es"
EMOTION_SOURCE = "goemotions_es"
EXTRA_SOURCE = "synthetic_so_like"
GENERATED_SOURCE = "synthetic_programming_final"
SYNTHETIC_PREFIX = "synthetic_"
REAL_SOURCES = ("so_es", "so_es_aug", "goemotions_es")

DONE_THRESHOLDS = {
    "f1_macro_mean": 0.38,
    "nivel_tecnico": 0.42,
    "urgencia": 0.55,
    "emocion": 0.26,
    "dominio": 0.18,
}
OVERFIT_GAP = 0.15
MAX_TRAIN_SYNTHETIC, MAX_EVAL_SYNTHETIC = 0.70, 0.55
#: Of every 20 rows.
SPLIT_SLOTS = {"train": 14, "val": 3, "test": 3}
# size of the corpus without real rows, and at most; least share of real rows, and what is added to it
DEFAULT_TARGET, MOST_TARGET = 10_000, 12_000
LEAST_REAL_SHARE, REAL_SHARE_MARGIN = 0.01, 0.005
# requests a minute of one client and of all; least score of a kept example
CLIENT_REQUESTS, ALL_REQUESTS, LEAST_SCORE = 20, 100, 3
BIAS_GRID = (-2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
BIAS_MIN_GAIN = 1e-9
RELIABLE_CONFIDENCE, WEAK_HEAD = 0.65, 0.5
EXAMPLE_MIN_CONFIDENCE, EXAMPLE_MIN_HEAD = 0.88, 0.65
PARITY_RTOL, PARITY_RTOL_EMOTION, PARITY_ATOL = 1e-4, 5e-4, 1e-5
REPLY_MAX_TOKENS = {"label": 120, "label_emotion": 220, "backfill": 96, "calibration": 120}
QUESTION_KEYS = (
    "question_id", "title", "body", "tags", "domain", "nivel_tecnico", "urgencia",
)

# --- patterns of label text leaked into question bodies (case-insensitive) ---------------
LABEL_KEYS_PATTERN = "(?:nivel_tecnico|urgencia|emocion|dominio)"
SNIPPET_MARK = "\n...[texto omitido]...\n"

# --- balanced template generation -------------------------------------------------------
DOMAIN_TOPICS = {
    "backend": ("API REST", "Django", "Node.js", "autenticacion", "colas de trabajo"),
    "frontend": ("React", "CSS", "estado de componentes", "formularios", "renderizado"),
    "bases_de_datos": ("SQL", "PostgreSQL", "indices", "joins", "migraciones"),
    "movil": ("Flutter", "Android", "notificaciones", "ciclo de vida", "permisos"),
    "devops": ("Docker", "Kubernetes", "CI/CD", "Nginx", "variables de entorno"),
    "data_science": ("pandas", "scikit-learn", "normalizacion", "metricas", "features"),
    "sistemas_seguridad": ("Linux", "concurrencia", "JWT", "permisos", "threads"),
    "general": (
        "programacion", "depuracion", "estructura del proyecto", "buenas practicas", "testing",
    ),
}
EMOTION_STYLE = {
    "frustracion": (
        "ya probe varias alternativas y el fallo se repite", "me esta costando aislar la causa",
    ),
    "confusion": (
        "no tengo claro que parte del flujo estoy interpretando mal",
        "me pierdo al conectar los conceptos",
    ),
    "curiosidad": (
        "quiero entender el motivo tecnico antes de decidir", "me interesa comparar las opciones",
    ),
    "ansiedad": ("esto bloquea una entrega cercana", "necesito destrabarlo con prioridad"),
    "motivacion": (
        "ya avance y quiero dejarlo mejor estructurado", "quiero aprovechar para hacerlo bien",
    ),
    "abrumado": (
        "hay demasiadas rutas posibles y no se cual elegir",
        "la cantidad de conceptos me esta saturando",
    ),
    "confiado": (
        "creo que el enfoque general es correcto", "tengo una hipotesis pero quiero validarla",
    ),
    "desesperado": (
        "llevo mucho tiempo intentando y no logro avanzar", "cada cambio abre otro error distinto",
    ),
    "neutral": (
        "busco una explicacion clara con un ejemplo", "quiero una respuesta directa y verificable",
    ),
}
LEVEL_STYLE = {
    "principiante": (
        "necesito una explicacion paso a paso", "todavia estoy afianzando los fundamentos",
    ),
    "intermedio": (
        "ya tengo una implementacion parcial", "puedo seguir codigo si me explican el criterio",
    ),
    "avanzado": (
        "quiero analizar rendimiento, concurrencia o arquitectura",
        "me preocupan los efectos borde y la mantenibilidad",
    ),
}
URGENCY_STYLE = {
    "baja": ("puedo revisarlo con calma", "no es bloqueante ahora mismo"),
    "media": (
        "quisiera resolverlo durante esta sesion", "me esta frenando el avance del dia",
    ),
    "alta": ("bloquea una entrega o despliegue", "necesito una ruta de solucion pronto"),
}
APP_CONTEXTS = (
    "un panel administrativo", "una app de cursos", "un modulo de pagos", "un dashboard interno",
    "una API publica", "un sistema de inventario", "una practica universitaria",
    "un prototipo movil", "una tarea de simulacion", "un flujo de autenticacion",
    "una pantalla de reportes", "un job programado", "una integracion con terceros",
    "un formulario dinamico", "una migracion de datos", "un servicio de notificaciones",
    "un entorno de pruebas", "un despliegue pequeño", "una libreria compartida",
    "un repositorio heredado", "una consulta recurrente", "un componente reutilizable",
    "un endpoint nuevo", "una tarea de mantenimiento", "un pipeline de datos",
    "una vista responsive", "un monitor de errores", "una configuracion local",
    "un caso de permisos", "una coleccion de pruebas", "un flujo asincrono",
)
CONSTRAINTS = (
    "con pocos archivos", "sin cambiar demasiado la estructura", "manteniendo compatibilidad",
    "con logs incompletos", "con ejemplos pequenos", "sin depender de servicios externos",
    "cuidando los tiempos de respuesta", "con datos de prueba limitados",
    "evitando repetir codigo", "con validaciones estrictas", "sin romper lo que ya funciona",
    "con nombres poco claros", "con varias capas involucradas", "desde una rama de trabajo",
    "con errores intermitentes", "pensando en una entrega academica",
    "con configuracion compartida", "usando una version reciente", "con documentacion escasa",
    "con cambios minimos", "comparando dos alternativas", "probando primero en local",
    "revisando una traza larga", "con entradas de usuario", "con datos en español",
    "buscando una solucion reproducible", "separando responsabilidades",
    "con una restriccion de tiempo", "sin perder legibilidad", "con varios casos borde",
    "optimizando solo lo necesario", "con dependencias ya instaladas",
    "a partir de codigo existente",
)
FAMILY_TEMPLATES = {
    "short_question": "Tengo una duda de {dominio} con {topic}: {level}. {emotion}. {urgency}. {tail}",
    "error_context": "Al trabajar con {topic} en {dominio}, aparece un comportamiento inesperado. {level}; {emotion}. {urgency}. {tail}",
    "academic_assignment": "Para una practica necesito explicar {topic} dentro de {dominio}. {level}. {emotion}, y {urgency}. {tail}",
    "production_bug": "En un flujo parecido a produccion, {topic} empezo a fallar en {dominio}. {urgency}. {emotion}. {level}. {tail}",
    "conceptual_explanation": "Quiero entender como se relaciona {topic} con {dominio}. {level}; {emotion}. {urgency}. {tail}",
    "comparison": "Estoy comparando dos enfoques para {topic} en {dominio}. {level}. {emotion}. {urgency}. {tail}",
    "refactor_review": "Estoy revisando una solucion de {dominio} basada en {topic}. {level}; {urgency}; {emotion}. {tail}",
    "debugging_trace": "Tengo trazas y sintomas alrededor de {topic} en {dominio}. {emotion}. {level}. {urgency}. {tail}",
    "architecture_decision": "Debo decidir como organizar {topic} en un proyecto de {dominio}. {level}. {emotion}. {urgency}. {tail}",
    "minimal_repro": "Necesito un ejemplo minimo sobre {topic} en {dominio}. {level}. {urgency}. {emotion}. {tail}",
}
TAIL_TEMPLATE = "El contexto es {context}, {constraint}."
GENERATOR_NAME = "diverse_template_final"
TOPUP_SEED_STEP = 1_000_003
