"""Words that name topics, help, kinds of pages and categories of programmes."""

# Topics and the words that name them; a topic is found by whole words in any case.
TOPICS = {
    "rental_assistance": r"rent(?:al)?|housing|evictions?|tenants?|foreclosure",
    "shelter": r"shelters?|homeless(?:ness)?|unhoused|transitional housing|safe parking",
    "food": r"food|meals?|nutrition|hunger|calfresh|snap|wic",
    "utility": r"utilit(?:y|ies)|energy assistance|electric(?:ity)? bills?|water bills?|heating|liheap|lihwap|internet access|broadband",
    "employment": r"employment|unemployment|job(?:s|less)?|workforce|vocational|career training|apprenticeships?|caljobs",
    "legal": r"legal (?:aid|help|services|assistance)|tenant rights|legal rights|legal clinics?|immigration|lawyers?|attorneys?|expungement",
    "public_benefits": r"public benefits|cash (?:aid|assistance)|financial (?:aid|assistance)|general (?:assistance|relief)|calworks|capi|ssi|ssdi|tax credits?|earned income|cal eitc|caleitc|benefitscal",
    "health_care": r"health(?:care| care| coverage| insurance| services)?|medical|dental|vision care|clinics?|prescriptions?|medi[ -]?cal|medicare|covered california|calaim",
    "family_support": r"child(?:ren|care| care| support)?|famil(?:y|ies)|parents?|pregnan(?:cy|t)|maternal|infants?|foster youth|youth services|domestic violence",
    "veteran_support": r"veterans?|military famil(?:y|ies)|calvet|service members?",
    "older_adult_support": r"seniors?|older adults?|elderly|aging|ageing",
    "disability": r"disabilit(?:y|ies)|disabled|ihss|in[ -]home supportive services|developmental services",
    "mobility_impairment": r"mobility|wheelchairs?|paratransit|assistive (?:devices?|technology)|accessible transportation",
    "mental_health_condition": r"mental health|behavioral health|behavioural health|depression|anxiety|psychiatric|schizophrenia|bipolar|ptsd|suicide prevention|crisis counseling",
    "substance_use_disorder": r"substance (?:use|abuse)|addiction|alcohol(?:ism| treatment)?|drug treatment|opioids?|recovery services|detox",
    "diabetes": r"diabet(?:es|ic)|insulin",
    "cancer": r"cancer|oncology|chemotherapy",
    "chronic_illness": r"chronic (?:illness(?:es)?|conditions?|diseases?)|long[ -]term (?:illness(?:es)?|conditions?)",
    "heart_disease": r"heart (?:disease|failure|conditions?)|cardiac|cardiovascular",
    "kidney_disease": r"kidney (?:disease|failure)|renal|dialysis",
    "respiratory_condition": r"asthma|copd|respiratory (?:conditions?|diseases?)|lung (?:disease|conditions?)",
    "hiv_aids": r"hiv(?:/aids)?|acquired immunodeficiency syndrome|(?<!hearing )(?<!visual )(?<!mobility )aids (?:drug|treatment|services?|care|support|assistance|programs?|benefits)|adap|ryan white",
}

# Names of programmes, services given directly, and signs of practical help.
NAMED_PROGRAMS = r"calfresh|medi[ -]?cal|calworks|wic|liheap|lihwap|caljobs|benefitscal|covered california|calaim|ssi|ssdi|capi|ihss|in[ -]home supportive services|adap|ryan white|calvet|california children['’]s services"
DIRECT_SERVICES = (
    r"rental assistance|housing assistance|eviction prevention|emergency shelter|food banks?|food pantr(?:y|ies)|food assistance|free meals?|meal delivery|utility assistance|energy assistance|job training|job search assistance|"
    r"legal aid|legal assistance|financial assistance|cash assistance|disability services|mobility assistance|patient assistance|prescription assistance|health coverage|support groups?|crisis (?:line|hotline)|treatment services|"
    r"child care assistance|childcare assistance|veteran services|veterans services"
)
HELP_SIGNALS = {
    "apply_or_enroll": r"apply|applying|applications?|enroll(?:ment)?|register|sign up|eligib(?:le|ility)|qualif(?:y|ies|ications?)",
    "services_or_support": r"assistance|support|services?|benefits|help|counseling|counselling|referrals?|case management",
    "access_or_affordability": r"free|low[ -]cost|no[ -]cost|affordable|reduced[ -]cost|sliding scale|subsid(?:y|ies|ized)|fee waivers?|hotlines?|helplines?|appointments?|find (?:a|an|your)|get care|get help|call (?:us|today)",
}

# Kinds of pages that offer no help, by title or heading, and by path.
PAGE_TYPES = {
    "procurement": (r"procurement|requests? for proposals?|requests? for qualifications?|rfp|rfq|bid opportunities|contract opportunities|vendor solicitations?|notice inviting bids", r"procurement|rfp|rfq|bids|solicitations"),
    "meeting_or_agenda": (r"meeting (?:minutes|agendas?)|board (?:meeting|agenda)|commission (?:meeting|agenda)|agenda packet|minutes of", r"agendas?|minutes"),
    "news_or_archive": (r"press releases?|news releases?|newsroom|news archive|news archives|press archive|archived news", r"news|newsroom|press-releases?|news-releases?|archives?"),
    "employer_recruitment": (r"job postings?|job openings?|job vacancies|employment opportunities|career opportunities|current vacancies|join our team|work (?:with|for|at) us|we['’]re hiring", r"careers|job-openings|job-opportunities|job-postings|employment-opportunities"),
    "research_or_statistics": (r"research reports?|statistical reports?|annual reports?|data dashboards?|surveillance reports?", r"statistics|data-dashboard"),
}
ACTIONS = r"apply|enroll|sign up|get help|find (?:a|an)|request (?:help|assistance)|(?:program|service) application"
SEEKERS = r"job seekers?|job training|job search|find a job|career training|career counseling|employment assistance|unemployment benefits|career centers?|employment centers?"

# Categories of programmes in the order in which titles are searched.
CATEGORY_WORDS = {
    "shelter": r"emergency shelter|temporary shelter|homeless shelter|homeless(?:ness)? assistance|shelter services?",
    "rental_assistance": r"rental assistance|rent assistance|eviction (?:prevention|help)|housing (?:assistance|support|programs?)",
    "food": r"food assistance|food bank|food pantry|calfresh|snap|wic|free meals?|meal program",
    "utility": r"utility assistance|energy assistance|liheap|help (?:with|paying) (?:your )?(?:energy|utility|electric|water) bills?",
    "legal": r"legal aid|legal help|legal services?|tenant rights|free or low-cost legal|bankruptcy",
    "employment": r"employment assistance|job training|job search|workforce development|unemployment benefits|services for job seekers?",
    "benefits": r"earned income tax credit|cal(?:ifornia)?e?itc|tax credit|cash[- ]back tax credit|cash back tax credit",
    "substance_use": r"substance use|addict(?:ed|ion)|recovery|rehab|detox|opioid|meth(?:amphetamine)?|fentanyl|cocaine|heroin",
    "mental_health": r"mental health|behavioral health|mental health counseling|crisis counseling|depression|anxiety|ptsd|bipolar|schizophrenia",
    "veteran_support": r"veteran|calvet|military",
    "older_adult_support": r"seniors?|older adults?|aging|elderly|fall prevention|medicare counseling",
    "family_support": r"family caregiver|caregiver services|child care|childcare|parenting|pregnancy|maternal|foster",
    "disability": r"disability|disabilities|disabled|independent living|assistive technology",
    "health": r"health care|healthcare|medical care|clinic|medi[- ]cal",
    "condition_support": r"diabetes|cancer|hiv|aids|heart disease|kidney disease|asthma|copd",
}
