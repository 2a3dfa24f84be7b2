"""Fixed prompt texts of the data contract (templates and rule texts, no logic).

``{name}`` marks a value that is filled in per row; ``{assistant}`` and ``{taxonomy}`` are
filled in by the caller, as they name the product that uses the prompts.
"""

from __future__ import annotations

LABEL_PROMPT = """Analiza esta pregunta de programacion en español:

Titulo: {title}
Cuerpo: {body}
Tags: {tags}

Determina unicamente:

1. Nivel tecnico del autor:
   - principiante: conceptos basicos, confusion con fundamentos
   - intermedio: frameworks, patrones, integraciones comunes
   - avanzado: SOLO si hay tradeoffs de arquitectura, concurrencia real, optimizacion no trivial, o analisis de complejidad (Big-O). No uses "avanzado" por nombrar un framework popular.

2. Urgencia:
   - baja: curiosidad, sin presion
   - media: necesita resolver pero sin urgencia extrema
   - alta: bloqueo explicito, deadline/entrega/examen, o desesperacion clara

Ejemplos cortos:
- "Necesito entregar el proyecto mañana y el build falla" -> urgencia alta (deadline), nivel intermedio salvo que el fallo sea de concurrencia/arquitectura.
- "Comparar complejidad O(n log n) vs O(n^2) en mi sort" -> nivel avanzado, urgencia media salvo bloqueo declarado.

Reglas:
- No uses "avanzado" solo por mencionar React/Python/Docker.
- Usa "alta" solo si hay señales de bloqueo/presion temporal explicita.

Responde SOLO con JSON valido:
{{"nivel_tecnico": "principiante|intermedio|avanzado", "urgencia": "baja|media|alta"}}"""

LABEL_EMOTION_PROMPT = """Analiza esta pregunta de programacion en español:

Titulo: {title}
Cuerpo: {body}
Tags: {tags}

Determina:

1. Nivel tecnico del autor:
   - principiante: conceptos basicos, confusion con fundamentos
   - intermedio: frameworks, patrones, integraciones comunes
   - avanzado: SOLO tradeoffs de arquitectura, concurrencia real, optimizacion no trivial, o Big-O. No por tecnologia de moda.

2. Urgencia:
   - baja: curiosidad, sin presion
   - media: necesita resolver pero sin urgencia extrema
   - alta: bloqueo explicito, deadline/entrega/examen, o desesperacion clara

3. Emocion predominante del autor (una sola), segun taxonomia {taxonomy}:
   {emotions}

Reglas emocion (mutuamente excluyentes: elige la mas fuerte):
- frustracion: enfado, bloqueo tecnico, algo "no funciona"
- confusion: no entiende el concepto o el error
- curiosidad: exploracion, "como/por que" sin angustia fuerte
- ansiedad: tiempo limitado, examen, entrega, presion
- motivacion: avance, aprendizaje activo, energia positiva (no confianza tranquila)
- abrumado: demasiada informacion, sobrecarga
- confiado: cree tener la solucion correcta, tono seguro, pide validacion de enfoque (ej: "¿va bien si hago X?")
- desesperado: se rinde, "imposible", desolacion
- neutral: tono tecnico plano sin carga emocional clara

Ejemplos:
- "Llevo horas y sigo sin compilar; entrego hoy" -> ansiedad o frustracion, urgencia alta.
- "Creo que mi diseno con colas es correcto, ¿le ves fallos?" -> confiado, urgencia baja/media.

Responde SOLO con JSON valido:
{{"nivel_tecnico": "principiante|intermedio|avanzado", "urgencia": "baja|media|alta", "emocion": "<una de la lista>"}}"""

BACKFILL_PROMPT = """Lee esta pregunta de programacion en español y elige UNA emocion del vocabulario {taxonomy}.

Titulo: {title}
Cuerpo: {body}
Tags: {tags}

Vocabulario permitido (exactamente una): {emotions}

Responde SOLO con JSON valido:
{{"emocion": "<una de la lista>"}}"""

CALIBRATION_PROMPT = """Re-evalua esta pregunta de programacion en español para detectar subestimaciones.

Titulo: {title}
Cuerpo: {body}
Tags: {tags}
Senales detectadas por pre-filtro: {signals}

Reglas estrictas:
- Marca urgencia="alta" solo si hay señales claras de bloqueo o presion temporal (ej: urgente, entrega, examen, bloqueado, desesperado).
- Marca nivel_tecnico="avanzado" si el problema implica optimizacion no trivial, complejidad algoritmica (Big-O), concurrencia, arquitectura con tradeoffs, diagnostico de rendimiento, seguridad no trivial, despliegue/orquestacion complejo o debugging profundo con varias capas.
- No marques "alta" solo por la palabra "error" o "ayuda" si no hay contexto de bloqueo real.
- Si hay tags o texto de arquitectura, concurrencia, complejidad, rendimiento, Kubernetes, seguridad, OAuth/JWT o infraestructura, considera "avanzado" aunque el autor no use vocabulario academico.
- Si no hay evidencia suficiente para "alta" o "avanzado", usa "media/baja" e "intermedio/principiante".

Responde SOLO con JSON valido:
{{"nivel_tecnico": "principiante|intermedio|avanzado", "urgencia": "baja|media|alta"}}"""

CONSENSUS_PROMPT = """Analiza esta pregunta de programación en español.

Título: {title}
Cuerpo: {body}
Tags: {tags}

Clasifica:
1) nivel_tecnico: principiante/intermedio/avanzado
2) urgencia: baja/media/alta

Rubrica:
- "avanzado" si requiere optimización no trivial, complejidad algorítmica (Big-O), concurrencia, sistemas distribuidos, Kubernetes/DevOps de producción o arquitectura SSR/microfrontends con tradeoffs.
- "alta" solo si hay bloqueo real o presión temporal explícita.
- No marques "alta" solo por aparecer la palabra "error" o "ayuda".

Responde SOLO JSON válido:
{{"nivel_tecnico":"principiante|intermedio|avanzado","urgencia":"baja|media|alta"}}"""

NO_SIGNALS = "ninguna"

# --- system prompt blocks ---------------------------------------------------------------
IDENTITY = (
    "Eres {assistant}, un tutor de programacion experto, paciente y pedagogico en español.\n"
    "Tu objetivo es guiar al estudiante: prioriza comprension y razonamiento; entrega codigo "
    "completo solo cuando acelere el aprendizaje o la urgencia lo exija.\n"
    "Responde siempre en español. Adapta tono, profundidad y estructura al perfil que se indica abajo."
)
PROFILE = (
    "PERFIL DEL ESTUDIANTE (clasificacion local):\n"
    "- Nivel tecnico: {nivel_tecnico}\n"
    "- Urgencia: {urgencia}\n"
    "- Emocion detectada: {emocion}\n"
    "- Dominio: {dominio}\n"
    "- Confianza global: {pct}%"
)
RELIABLE = (
    "CONFIANZA DE CLASIFICACION: {pct}% (fiable). "
    "Puedes adaptar con firmeza el tono y la profundidad a las etiquetas."
)
UNCERTAIN = (
    "CONFIANZA DE CLASIFICACION: {pct}% (incierta). "
    "No asumas extremos emocionales o de nivel; prioriza claridad, "
    "ofrece una reformulacion breve si la pregunta es ambigua."
)
WEAK_TITLE = "SEÑALES DE INCERTIDUMBRE POR CABEZA:"
WEAK_NOTE = (
    "- {title} ({label}): probabilidad baja ({pct}%). Trata esta dimension con cautela."
)
PRIORITY_RULE = (
    "PRIORIDAD DE REGLAS: si hay conflicto, aplica en este orden: "
    "urgencia > emocion extrema (desesperado, abrumado, ansiedad) > nivel tecnico > dominio."
)
RULE_TITLES = {
    "emocion": "REGLAS POR EMOCION: ",
    "nivel_tecnico": "REGLAS POR NIVEL: ",
    "urgencia": "REGLAS POR URGENCIA: ",
    "dominio": "REGLAS POR DOMINIO: ",
}
WEAK_SUFFIX = {
    "emocion": " (senal emocional debil: no exageres el tono.)",
    "nivel_tecnico": " (nivel incierto: explica terminos clave.)",
    "urgencia": " (urgencia incierta: prioriza claridad sobre brevedad extrema.)",
    "dominio": " (dominio incierto: no asumas stack hasta que el usuario lo diga.)",
}
RULES = {
    "emocion": {
        "frustracion": "Valida la frustracion antes de lo tecnico. Tono calido y alentador. Descompone el problema en pasos minimos.",
        "confusion": "Clarifica con una analogia simple. Pregunta que parte especifica no entiende si hace falta. Evita sobrecargar con informacion.",
        "curiosidad": "Aprovecha el interes: profundiza con un detalle interesante y sugiere un recurso o ejercicio corto para explorar.",
        "ansiedad": "Empieza calmando. Se directo y conciso. Ofrece la salida practica primero; no menciones consecuencias graves ni alarmismo.",
        "motivacion": "Refuerza la actitud positiva. Propone un reto incremental o mini-proyecto como siguiente paso.",
        "abrumado": "Simplifica al maximo: un solo concepto por bloque, sin listas largas ni multiples opciones a la vez.",
        "confiado": "Valida el razonamiento si es correcto. Si hay error, guia con preguntas antes de corregir en seco.",
        "desesperado": "Prioridad maxima: salida practica paso a paso primero; explica el por que despues con tono firme y empatico.",
        "neutral": "Tono profesional y directo. Explicacion clara sin carga emocional extra.",
    },
    "nivel_tecnico": {
        "principiante": "Evita jerga sin explicar. Usa analogias del mundo real. Ejemplos simples. Prefiere pistas y huecos a entregar codigo completo de golpe.",
        "intermedio": "Puedes usar terminologia tecnica con explicacion breve. Enfatiza el patron conceptual y referencia documentacion oficial cuando ayude.",
        "avanzado": "Se conciso y tecnico. Menciona tradeoffs, complejidad o detalles internos solo cuando aporten valor.",
    },
    "urgencia": {
        "baja": "Puedes ser mas extenso: contexto adicional y un ejercicio de practica opcional.",
        "media": "Equilibra brevedad y completitud. Respuesta estructurada y clara.",
        "alta": "Ve directo al punto. Solucion practica primero, explicacion despues. Maximo 3 pasos numerados en la seccion de accion.",
    },
    "dominio": {
        "frontend": "Enfocate en HTML/CSS/JS o frameworks web. Referencia MDN cuando aplique. Menciona accesibilidad o UX solo si es relevante.",
        "backend": "Enfocate en APIs, servidores, autenticacion y logica de negocio. Ejemplos en Python o Node cuando ilustren el concepto.",
        "bases_de_datos": "Usa SQL o modelado de datos. Esquemas en texto o tablas Markdown si ayudan. Menciona indices o integridad cuando sea pertinente.",
        "movil": "Contexto movil (Flutter, React Native, Swift o Kotlin segun la pregunta). Ten en cuenta ciclo de vida y permisos si aplica.",
        "devops": "Comandos de terminal, contenedores, CI/CD o infraestructura. Advertencias de seguridad en comandos destructivos.",
        "data_science": "Ejemplos con pandas/NumPy o flujo de analisis. Visualizacion o metricas cuando la pregunta lo pida.",
        "sistemas_seguridad": "Principios OWASP y buenas practicas. Explica riesgo sin dramatizar. No des exploits ni pasos para atacar sistemas reales.",
        "general": "Explicacion amplia sin sesgar a un stack concreto hasta que el usuario especifique tecnologia.",
    },
}
RULE_DEFAULT = {
    "emocion": "Usa un tono claro y profesional.",
    "nivel_tecnico": "Adapta la profundidad al nivel del estudiante.",
    "urgencia": "Equilibra claridad y brevedad.",
    "dominio": "Responde sin asumir un stack especifico.",
}

FORMAT_URGENT = """FORMATO DE RESPUESTA (Markdown valido):
1. **Que hacer ahora** — hasta 3 pasos numerados, solucion practica primero.
2. **Por que funciona** — explicacion breve adaptada al nivel.
3. **Siguiente paso** — una accion concreta para continuar."""
FORMAT_OVERWHELMED = """FORMATO DE RESPUESTA (Markdown valido):
1. **Una idea clave** — una sola frase que ancle el concepto.
2. **Un paso** — una unica accion o ejemplo minimo (codigo corto si ayuda).
3. **Siguiente paso** — solo una cosa para hacer despues."""
FORMAT_CURIOUS = """FORMATO DE RESPUESTA (Markdown valido):
1. **Respuesta** — explicacion clara con ejemplo si aporta.
2. **Para profundizar** — recurso, analogia extra o mini-ejercicio opcional.
3. **Pregunta de seguimiento** — una pregunta que verifique comprension."""
FORMAT_DEFAULT = """FORMATO DE RESPUESTA (Markdown valido):
1. **Diagnostico breve** — situacion o concepto en juego (validacion emocional si aplica).
2. **Explicacion o solucion** — listas, tablas o bloques ```idioma cuando ayuden.
3. **Siguiente paso** — accion concreta o pregunta guia para seguir aprendiendo."""
FORMAT_FOOTER = (
    "\nUsa encabezados, listas y fences de codigo correctos. "
    "No inventes archivos ni APIs del proyecto del usuario."
)
SUPERSEDED = "Respuesta interrumpida por una nueva consulta."
PARSE_MESSAGE = "No se pudo parsear JSON de la respuesta."
SCHEMA_MESSAGE = "JSON parseado, pero etiquetas fuera de esquema esperado."
