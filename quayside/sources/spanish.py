"""Spanish words and what they are rewritten to, without accents and in lower case."""

# Words that tell Spanish.
MARKERS = r"\b(?:yo|mi|mis|tengo|tenemos|necesito|necesitamos|ayuda|estoy|estamos|somos|vivo|vivimos|renta|alquiler|comida|trabajo|hijos?|hijas?|ninos|esposo|esposa|dinero|pagar|puedo|podemos|desalojo|desalojar|casa|con|para|por|pero|porque|luz|mes|semana|gano|ganamos|soy|que|los|las|una?|del|al)\b"

# Phrases and their rewrites in order; in each list, no rewrite is part of a later phrase of the same list.
NUMBERS = [
    (r"\b(?:un|una|uno)\b(?= (?:hij|nin|bebe|nene|mes|semana))", "one"),
    (r"\bdos\b", "two"),
    (r"\btres\b", "three"),
    (r"\bcuatro\b", "four"),
    (r"\bcinco\b", "five"),
    (r"\bseis\b", "six"),
    (r"\bsiete\b", "seven"),
    (r"\bocho\b", "eight"),
    (r"\bmil\b", "thousand"),
]
HOUSING = [
    (r"\b(?:aviso|orden|notificacion|carta) de (?:desalojo|desahucio)\b", "eviction notice"),
    (r"\baviso de (?:3|tres|30|treinta|60|sesenta) dias\b", "3-day notice"),
    (r"\b(?:me|nos) (?:van a|quieren|puede[n]?) (?:desalojar|sacar|correr)\b", "i might get evicted"),
    (r"\b(?:me|nos) (?:desalojaron|sacaron|corrieron|echaron)\b", "we got kicked out"),
    (r"\b(?:desalojo|desahucio)\b", "eviction"),
    (r"\b(?:atrasad[oa]s?|debo|debemos) (?:en|con)? ?(?:la |el )?(?:renta|alquiler|arriendo)\b", "behind on rent"),
    (r"\b(?:de|para|en) (?:la |el )?(?:renta|alquiler|arriendo)\b", "for rent"),
    (r"\b(?:renta|alquiler|arriendo)\b", "rent"),
    (r"\b(?:el |la )?(?:casero|casera|dueno|duena|propietario|arrendador|landlord)\b", "landlord"),
    (r"\b(?:sin hogar|sin casa|indigente|vivo en la calle|en la calle)\b", "homeless"),
    (r"\b(?:vivo|vivimos|duermo|dormimos) en (?:mi|el|un|nuestro) (?:carro|coche|auto|camioneta|troca)\b", "sleeping in my car"),
    (r"\b(?:refugio|albergue)\b", "shelter"),
    (r"\bno (?:tengo|tenemos) (?:donde|a donde) (?:dormir|quedarme|quedarnos|ir|vivir)\b", "nowhere to go"),
    (r"\b(?:donde dormir|donde quedarme|lugar para dormir)\b", "place to sleep"),
    (r"\b(?:apartamento|departamento|depa)\b", "apartment"),
    (r"\bvivienda (?:economica|asequible)\b", "affordable housing"),
]
MONEY = [
    (r"\bno (?:puedo|podemos) pagar\b", "can't pay"),
    (r"\bno (?:me |nos )?alcanza\b", "can't afford"),
    (r"\b(?:gano|cobro)\b", "i make"),
    (r"\b(?:ganamos|cobramos)\b", "we make"),
    (r"\brecibo\b", "i receive"),
    (r"\brecibimos\b", "we receive"),
    (r"\b(?:gana|cobra)\b", "makes"),
    (r"\b(?:al|por|cada) mes\b|\bmensual(?:es)?\b", "a month"),
    (r"\b(?:a la|por|cada) semana\b|\bsemanal(?:es)?\b", "a week"),
    (r"\b(?:al|por|cada) ano\b|\banual(?:es)?\b", "a year"),
    (r"\b(?:por|la) hora\b", "an hour"),
    (r"\bdolares\b", "dollars"),
    (r"\b(?:sin|no tengo|no tenemos) (?:trabajo|empleo)\b", "out of work"),
    (r"\b(?:sin|no tengo|no tenemos) (?:dinero|ingresos)\b", "no income"),
    (r"\bdinero\b", "money"),
    (r"\bingresos?\b", "income"),
    (r"\bseguro social\b", "social security"),
    (r"\bdesempleo\b", "unemployment"),
    (r"\bestampillas(?: de comida)?\b|\bcupones de comida\b", "food stamps"),
]
WORK = [
    (r"\b(?:me|lo|la) (?:despidieron|corrieron del trabajo)\b|\bperdi (?:mi|el) (?:trabajo|empleo)\b", "i got laid off"),
    (r"\b(?:me|le) (?:cortaron|redujeron|bajaron) (?:las )?horas\b", "hours got cut"),
    (r"\bdesemplead[oa]\b", "unemployed"),
    (r"\b(?:trabajo|empleo|chamba)\b", "job"),
]
FOOD = [
    (r"\bbanco de (?:comida|alimentos)\b", "food bank"),
    (r"\b(?:comida|alimentos|despensa|mandado)\b", "food"),
    (r"\bhambre\b", "hungry"),
    (r"\bpanales\b", "diapers"),
    (r"\bleche (?:de|para) bebe\b|\bformula\b", "formula"),
]
UTILITIES = [
    (r"\b(?:nos|me) (?:van a )?(?:cortar|cortaron|quitar|quitaron) (?:la )?(?:luz|electricidad)\b", "lights got shut off"),
    (r"\b(?:recibo|factura|cuenta|bill) de (?:la )?(?:luz|electricidad)\b", "electric bill"),
    (r"\b(?:recibo|factura|cuenta) del? (?:gas)\b", "gas bill"),
    (r"\b(?:recibo|factura|cuenta) del? (?:agua)\b", "water bill"),
    (r"\b(?:luz|electricidad)\b", "electricity"),
    (r"\b(?:recibo|factura|cuenta)s?\b", "bill"),
]
LEGAL = [
    (r"\b(?:abogad[oa]|licenciad[oa])\b", "lawyer"),
    (r"\b(?:corte|tribunal|juzgado)\b", "court"),
    (r"\bayuda legal\b", "legal help"),
    (r"\binmigracion\b", "immigration"),
]
HEALTH = [
    (r"\b(?:seguro medico|aseguranza|seguro de salud)\b", "health insurance"),
    (r"\b(?:medico|doctora?)\b", "doctor"),
    (r"\bclinica\b", "clinic"),
    (r"\b(?:medicinas?|medicamentos?)\b", "medicine"),
    (r"\bdentista\b", "dentist"),
    (r"\bembarazada\b", "pregnant"),
    (r"\b(?:depresion|deprimid[oa])\b", "depression"),
    (r"\bansiedad\b", "anxiety"),
    (r"\b(?:discapacidad|discapacitad[oa]|incapacidad)\b", "disability"),
]
FAMILY = [
    (r"\b(?:violencia domestica|abuso|me pega|me golpea|me maltrata)\b", "domestic violence"),
    (r"\b(?:cuidado de ninos|guarderia)\b", "childcare"),
    (r"\b(?:madre|mama) soltera\b", "single mom"),
    (r"\b(?:padre|papa) soltero\b", "single dad"),
    (r"\b(?:hijos|hijas|ninos|ninas|nenes|chamacos|chiquitos|criaturas)\b", "kids"),
    (r"\bhijo\b", "son"),
    (r"\bhija\b", "daughter"),
    (r"\b(?:bebe|nene)\b", "baby"),
    (r"\b(?:esposo|marido)\b", "husband"),
    (r"\besposa\b", "wife"),
    (r"\b(?:pareja|novio|novia)\b", "partner"),
]
PEOPLE = [
    (r"\b(?:mi )?mama\b", "my mom"),
    (r"\b(?:mi )?papa\b", "my dad"),
    (r"\bno (?:tengo|tenemos) kids\b", "no kids"),
    (r"\bno soy veteran[oa]\b", "not a veteran"),
    (r"\bveteran[oa]\b", "veteran"),
    (r"\bfamilia de\b", "family of"),
    (r"\bsomos\b", "we are"),
    (r"\b(?:vivo|estoy) sol[oa]\b", "live alone"),
    (r"\btengo (\d{2}) anos\b", "i am $1"),
    (r"\b(?:personas|miembros)\b", "people"),
    (r"\b(?:de la tercera edad|adulto mayor|anciano|jubilad[oa])\b", "senior"),
]
GLUE = [
    (r"\b(?:necesito|necesitamos)\b", "need"),
    (r"\bayuda\b", "help"),
    (r"\btengo\b", "i have"),
    (r"\btenemos\b", "we have"),
    (r"\b(?:estoy|soy)\b", "i'm"),
    (r"\b(?:vivo|vivimos)\b", "i live"),
    (r"\bmis?\b", "my"),
    (r"\bnuestr[oa]s?\b", "our"),
    (r"\bcon\b", "with"),
    (r"\ben\b", "in"),
    (r"\by\b", "and"),
    (r"\b(?:es|son|era)\b", "is"),
    (r"\bpago\b", "pay"),
    (r"\bpero\b", "but"),
    (r"\bpara\b", "for"),
    (r"\bno puedo\b", "can't"),
]
REWRITES = [NUMBERS, HOUSING, MONEY, WORK, FOOD, UTILITIES, LEGAL, HEALTH, FAMILY, PEOPLE, GLUE]
