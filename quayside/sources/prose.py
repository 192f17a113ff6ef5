"""The texts from which a plan is written, by language and key, and labels of categories and statuses."""

# Texts in English.
ENGLISH = {
    "need.rental_assistance": "Rent",
    "need.food": "Food",
    "need.utility": "Utility bills",
    "need.shelter": "A place to stay",
    "need.employment": "Work",
    "need.legal": "Legal help",
    "need.health": "Health care",
    "need.benefits": "Money / benefits",
    "need.family_support": "Family & kids",
    "need.veteran_support": "Veteran services",
    "need.older_adult_support": "Older adults",
    "need.disability": "Disability",
    "need.mental_health": "Mental health",
    "need.substance_use": "Recovery",
    "need.condition_support": "Health condition",
    "explain.none.summary": "We could not find any programs that match what you told us. Try adding your city or county, or call 211 for a referral to local help.",
    "explain.none.step1": "Call 211 (free, 24/7) and describe your situation.",
    "explain.none.step2": "Add more detail above and try again.",
    "explain.summary": "Based on what you shared — {status} — we found {n} programs that may be able to help, starting with {top}.",
    "explain.summary.one": "Based on what you shared — {status} — we found 1 program that may be able to help: {top}.",
    "explain.allConfirmed": "Everything we could check matched what you told us, but each organization makes the final decision.",
    "explain.someUnverified": "{n} of them still need eligibility confirmed with the organization.",
    "explain.urgent": "Act today: your situation is time-sensitive, so start with the fastest options first.",
    "explain.contact": "Contact {name}{phone}",
    "explain.bring": " — bring {list}",
    "explain.andMore": ", and more",
    "explain.tell": "Tell each organization exactly what you told us; they will confirm whether you qualify.",
    "explain.status.eviction_notice": "you have received an eviction notice",
    "explain.status.unhoused": "you are currently without housing",
    "explain.status.housed_at_risk": "you are at risk of losing your housing",
    "explain.status.housed_stable": "you are housed but need support",
    "explain.needs.none": "you are looking for help",
    "explain.needs.some": "you are looking for help with {list}",
    "explain.and": " and ",
    "call.opener": "Hi, I'm calling about {program}.{facts} Could you tell me if I might qualify and how to apply?",
    "call.fact.place": "I live in {place}.",
    "call.fact.household": "There are {n} people in my household.",
    "call.fact.alone": "I live alone.",
    "call.fact.income": "Our income is about {amount} a month.",
    "call.fact.noIncome": "We don't have any income right now.",
    "call.fact.notice": "I got an eviction notice.",
    "call.fact.behind": "I'm behind on rent.",
    "call.fact.unhoused": "I don't have a place to live right now.",
    "call.fact.veteran": "I'm a veteran.",
    "call.q.area": "Do you serve people who live in {place}?",
    "call.q.income": "What's the income limit for a household of {size}?",
    "call.q.housing": "Can you help someone in my housing situation?",
    "call.q.notice": "Do I need an eviction notice to get help?",
    "call.q.children": "Do I need to have children at home to qualify?",
    "call.q.veteran": "Is this only for veterans?",
    "call.q.other": "Are there any other requirements I should know about?",
    "call.q.docs": "What documents should I bring?",
    "call.q.time": "How long does it usually take to get help?",
    "call.q.waitlist": "Is there a waitlist? Can I get on it today?",
    "call.q.else": "If you can't help, who can?",
}

# Texts in Spanish.
SPANISH = {
    "need.rental_assistance": "Renta",
    "need.food": "Comida",
    "need.utility": "Luz, gas y agua",
    "need.shelter": "Un lugar donde quedarse",
    "need.employment": "Trabajo",
    "need.legal": "Ayuda legal",
    "need.health": "Atención médica",
    "need.benefits": "Dinero / beneficios",
    "need.family_support": "Familia e hijos",
    "need.veteran_support": "Servicios para veteranos",
    "need.older_adult_support": "Adultos mayores",
    "need.disability": "Discapacidad",
    "need.mental_health": "Salud mental",
    "need.substance_use": "Recuperación",
    "need.condition_support": "Condición de salud",
    "explain.none.summary": "No encontramos programas que coincidan con lo que nos dijo. Intente agregar su ciudad o condado, o llame al 211 para que lo refieran a ayuda local.",
    "explain.none.step1": "Llame al 211 (gratis, las 24 horas) y explique su situación.",
    "explain.none.step2": "Agregue más detalles arriba e intente de nuevo.",
    "explain.summary": "Según lo que nos contó ({status}), encontramos {n} programas que podrían ayudarle. Empiece con {top}.",
    "explain.summary.one": "Según lo que nos contó ({status}), encontramos 1 programa que podría ayudarle: {top}.",
    "explain.allConfirmed": "Todo lo que pudimos revisar coincide con lo que nos dijo, pero cada organización toma la decisión final.",
    "explain.someUnverified": "En {n} de ellos todavía hay que confirmar con la organización si usted califica.",
    "explain.urgent": "Actúe hoy: su situación es urgente, así que empiece por las opciones más rápidas.",
    "explain.contact": "Comuníquese con {name}{phone}",
    "explain.bring": " — lleve {list}",
    "explain.andMore": " y más",
    "explain.tell": "Dígale a cada organización exactamente lo que nos dijo a nosotros; ellos le confirmarán si califica.",
    "explain.status.eviction_notice": "recibió un aviso de desalojo",
    "explain.status.unhoused": "ahora no tiene vivienda",
    "explain.status.housed_at_risk": "está en riesgo de perder su vivienda",
    "explain.status.housed_stable": "tiene vivienda pero necesita apoyo",
    "explain.needs.none": "busca ayuda",
    "explain.needs.some": "busca ayuda con {list}",
    "explain.and": " y ",
    "call.opener": "Hola, llamo por {program}.{facts} ¿Me puede decir si podría calificar y cómo solicitar?",
    "call.fact.place": "Vivo en {place}.",
    "call.fact.household": "En mi hogar somos {n} personas.",
    "call.fact.alone": "Vivo solo.",
    "call.fact.income": "Nuestro ingreso es de unos {amount} al mes.",
    "call.fact.noIncome": "Ahora no tenemos ningún ingreso.",
    "call.fact.notice": "Recibí un aviso de desalojo.",
    "call.fact.behind": "Estoy atrasado con la renta.",
    "call.fact.unhoused": "Ahora no tengo dónde vivir.",
    "call.fact.veteran": "Soy veterano.",
    "call.q.area": "¿Atienden a personas que viven en {place}?",
    "call.q.income": "¿Cuál es el límite de ingresos para un hogar de {size}?",
    "call.q.housing": "¿Pueden ayudar a alguien en mi situación de vivienda?",
    "call.q.notice": "¿Necesito un aviso de desalojo para recibir ayuda?",
    "call.q.children": "¿Tengo que tener hijos en casa para calificar?",
    "call.q.veteran": "¿Es solo para veteranos?",
    "call.q.other": "¿Hay algún otro requisito que deba saber?",
    "call.q.docs": "¿Qué documentos debo llevar?",
    "call.q.time": "¿Cuánto tiempo tarda normalmente recibir ayuda?",
    "call.q.waitlist": "¿Hay lista de espera? ¿Me pueden anotar hoy?",
    "call.q.else": "Si ustedes no pueden ayudarme, ¿quién puede?",
}
LANGUAGES = {"en": ENGLISH, "es": SPANISH}

# What programmes of a category provide, how a housing status is said, and the parts of a note.
CATEGORY_LABELS = {
    "rental_assistance": "rental assistance",
    "food": "food assistance",
    "utility": "utility bill help",
    "shelter": "emergency shelter",
    "employment": "employment help",
    "legal": "legal help",
    "health": "health care",
    "benefits": "public benefits",
    "family_support": "family support",
    "veteran_support": "veteran services",
    "older_adult_support": "older adult services",
    "disability": "disability services",
    "mental_health": "mental health support",
    "substance_use": "substance-use support",
    "condition_support": "condition-specific support",
}
STATUS_LABELS = {"housed_stable": "stably housed", "housed_at_risk": "at risk of losing housing", "eviction_notice": "facing eviction", "unhoused": "currently unhoused"}
NOTE_PROVIDES, NOTE_MATCHES, NOTE_OPEN = "%s provides %s.", "What matches: %s", "Still to confirm: %s"
# How many programmes get a step, how many a note, how many documents and details are named; lengths of a card's text.
STEPS, NOTES, DOCUMENTS, DETAILS = 3, 6, 3, 2
CARD_SENTENCES, CARD_LEAST, CARD_MOST, CARD_CUT = 2, 45, 260, 257
