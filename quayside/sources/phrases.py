"""Phrases by which people describe their situation. All are read as regular expressions in any case."""

# Phrases of danger to oneself, in plain words and in slang, and the denial right before one that counts.
DIRECT_PHRASES = r"\b(?:suicid\w*|kill(?:ing)? myself|end(?:ing)? (?:my life|it all|everything)|take (?:my|my own) life|(?:don't|do not|dont) want to (?:live|be alive|be here|wake up|go on) (?:anymore|any more)?|(?:want|wanted|wanting|wish(?:ed)?|ready) to (?:die|be dead|not exist|disappear forever)|better off dead|(?:hurt|harm|cut|cutting|hurting|harming) myself|self[- ]?harm|no reason to (?:live|go on|keep going)|(?:life )?(?:isn't|is not|not) worth living|can't go on|jump off (?:a|the) (?:bridge|building|roof)|overdose on purpose|thinking about (?:ending|dying|death))\b"
SLANG_AND_EUPHEMISMS = r"\b(?:(?<!\d\s?)kms|un-?aliv(?:e|ed|es|ing)|kill(?:ing)? my ?self|(?:off|end|hang|poison) myself|shoot myself(?! in the (?:foot|leg))|drown myself(?! in (?:work|my work|school|studying))|(?:want(?:ed)?|wanna|going|gonna|ready|planning|trying|thinking (?:of|about)) (?:to )?end(?:ing)? it(?!\s+with\b)|(?:no ?one|nobody)(?: would|'d| will) miss me|better off without me|wish(?:ed)? (?:i|that i) (?:was|were) never born|wish(?:ed)? (?:i|that i) (?:wouldn't|would not|didn't|did not|could never|would never|could just not) wake up|(?:don't|do not|dont) want to (?:exist|be around)|(?:want|wanna) to disappear|slit(?:ting)? my (?:wrists|throat)|(?:take|taking) all (?:of )?my pills)\b"
EXPLICIT_DENIAL = r"(?:\b(?:not|never)\b|\bno (?:thoughts?|plans?|intention|desire|history) of)\s*(?:\w+\s+){0,2}$"

# Denials right before a word, those of a need, and legal words for which a plain "no" is a denial.
NEGATION_BEFORE = r"(?:\b(?:no|not|never|without|nor|none of)\b|\b(?:don't|do not|doesn't|does not|didn't|did not|won't|haven't|have not|hasn't|isn't|aren't|ain't|can't|cannot) (?:have|need|want|got|get|receive|received|use|require|qualify for))\s*(?:a|an|any|the|my|our|more|even|really)?\s*(?:[\w-]+\s+)?$"
NEED_DENIAL_BEFORE = r"(?:\b(?:don't|do not|doesn't|does not|didn't|did not|won't|no longer) (?:need|want|require|care about)|\bno need (?:for|of)|\bnot (?:looking for|asking for|worried about|in need of|seeking|about)|\b(?:not(?! enough)|never)(?: (?:a|an|really|currently|yet|actually))?)\s*(?:a|an|any|the|my|our|more|even|really)?\s*(?:[\w-]+\s+)?$"
LEGAL_WORD = r"^(?:evict\w*|court|notice|summons|lawyer|attorney|unlawful detainer)"

# Housing.
UNHOUSED = r"\b(?:homeless|unhoused|(?:living|sleeping|staying|live|sleep|stay|been living|been sleeping) (?:in|out of) (?:my |a |the |our )?(?:car|van|truck|tent|rv|camper|vehicle)|on the streets?|(?:in|at) (?:a|an|the) (?:emergency |homeless )?shelter|couch[- ]?surf\w*|no ?where to (?:go|stay|sleep|live)|no place to (?:stay|live|sleep|go)|(?:staying|crashing|living|sleeping|been staying|been sleeping) (?:at|with|on) (?:a |my |our |his |her |their )?(?:friend|sister|brother|mom|mother|dad|father|parent|cousin|aunt|uncle|grandma|grandmother|grandpa|relative|family member|buddy|coworker)(?:'s)?|(?:in|at) a (?:motel|hotel)|lost (?:my|our|the) (?:apartment|place|housing|home|house)|(?:got|been|was|were|getting) (?:kicked|thrown|put) out|encampment|sleeping (?:outside|rough))\b"
NOTICE = r"\b(?:eviction notice|notice to (?:vacate|quit)|pay[- ]or[- ](?:vacate|quit)|(?:3|three|5|five|10|ten|14|30|60|90)[- ]day notice|(?:got|received|was served|got served|served|been served|handed|given|have|has) (?:a |an |the |my |our )?(?:eviction |written |formal |court )?notice|unlawful detainer|court date|court summons|summons|landlord (?:filed|is suing|sued)|filed (?:for )?(?:an )?eviction|sheriff|lock(?:ed)? ?out|(?:got|been|was|were|getting|being|am being|are being) evicted)\b"
NOTICE_NEGATED = r"\b(?:no|not|haven't|hasn't|didn't|never|without|before|not yet|nothing)\b[^.!?;]{0,30}\b(?:notice|evict\w*|court)\b|\b(?:notice|evict\w*)\b[^.!?;]{0,12}\byet\b"
NOTICE_HEDGED = r"\b(?:might|may|could|about to|going to|gonna|worried|afraid|scared|fear|threaten\w*|trying to|wants to|want to|is going to|at risk of|facing|possible|possibly|soon|if i|before i|avoid|prevent|stop)\b[^.!?;]{0,30}\bevict"
AT_RISK = r"\b(?:behind\b[^.!?;]{0,20}\b(?:rent|mortgage|payments)|(?:\d+|two|three|four) months? behind|late (?:on|with) (?:the |my |our )?rent|owe [^.!?;]{0,25}(?:rent|landlord)|back rent|past[- ]due rent|rent (?:is |was )?(?:past due|overdue|late|due|coming up)|(?:can't|cannot|can not|couldn't|unable to|won't be able to|not able to|struggling to|no way to) (?:pay|afford|cover|make|come up with|keep up with) [^.!?;]{0,15}(?:rent|mortgage|housing|apartment|place)|short on rent|(?:lose|losing|going to lose) (?:my|our|the) (?:apartment|home|housing|place|house)|hours (?:got |were |have been )?(?:cut|reduced|dropped)[^.!?;]{0,40}\brent|landlord (?:says|said|told|wants|is telling|keeps telling)[^.!?;]{0,40}\b(?:out|leave|move)|(?:have|need) to be out by|move out by)\b"

# People.
KIDS_GROWN = r"\b(?:grown|adult) (?:kids|children|son|daughter)|kids are (?:grown|adults)|children are (?:grown|adults)\b"
NO_KIDS = r"\b(?:no|without|don't have(?: any)?|do not have(?: any)?)\s+(?:kids|children|dependents)\b|\bchildless\b"
PARTNER = r"\b(?:my|our|with my|and my|me and my) (?:wife|husband|partner|spouse|boyfriend|girlfriend|fianc[ée]e?|bf|gf)\b"
SINGLE_PARENT = r"\bsingle (?:mom|mother|dad|father|parent)\b"
PARTNER_GONE = r"\b(?:wife|husband|partner|spouse|boyfriend|girlfriend|bf|gf)\b[^.!?;]{0,25}\b(?:left|leaving|passed|died|moved out|walked out|kicked (?:me|us) out|is gone|in jail|in prison|deported)\b|\b(?:divorced|separated|widow(?:ed|er)?|getting a divorce)\b"
ALONE = r"\b(?:live alone|living alone|just me|by myself|on my own|only me|it's just me|no one else)\b"
VETERAN_POSITIVE = r"\b(?:veterans?|(?:i'm|i am|as|being|disabled|combat|retired|former) (?:a |an )?vet|vet (?:living|in|here|and|who|with|from|looking|needing)|served in the (?:army|navy|marines?|marine corps|air force|coast guard|military|national guard)|(?:i was|been|i've been) in the (?:army|navy|marines?|marine corps|air force|coast guard|military)|(?:army|navy|marine|marines|air force|coast guard) (?:veteran|vet)|military service|ex[- ]military|honorabl[ey] discharged|va benefits|va disability)\b"
VETERAN_NEGATIVE = r"\b(?:not a (?:veteran|vet)|never served|no military|not military|non[- ]veteran)\b"
NUMBER_WORD = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
KID_WORD = r"(?:kids?|children|child|sons?|daughters?|boys?|girls?|bab(?:y|ies)|toddlers?|infants?|teenagers?|teens?|little ones?|newborn)"
KID_COUNT = rf"\b(\d+|{NUMBER_WORD}|a|an)\s+(?:young |small |little |school[- ]age |minor )?{KID_WORD}\b"
KID_MENTION = rf"\b(?:my|our) (?:\d+[- ]year[- ]old|{KID_WORD})\b|\b{KID_WORD}\b|\bsingle (?:mom|mother|dad|father|parent)\b|\b(?:mom|mother|dad|father|parent) of (?:\d+|{NUMBER_WORD})\b|\b(?:child ?care|daycare|day care)\b"
PARENT_OF = rf"\b(?:single )?(?:mom|mother|mama|dad|father|parent) of (\d+|{NUMBER_WORD})\b"
ONE_KID = r"\b(?:my|our) (?:\d+[- ]year[- ]old|son|daughter|baby|toddler|infant|newborn|little one)\b"
HOUSEHOLD_SIZES = [
    rf"\b(?:family|household|house) of (\d+|{NUMBER_WORD})\b",
    rf"\b(\d+|{NUMBER_WORD}) (?:people|persons|of us|in (?:my|our|the) (?:house|home|apartment|household|family))\b",
    rf"\b(?:there (?:are|is)|we are|we're) (\d+|{NUMBER_WORD})(?: of us| people)?\b",
    rf"\bhousehold (?:size )?(?:is|of) (\d+|{NUMBER_WORD})\b",
]
ADULTS_AND_KIDS = rf"\b(\d+|{NUMBER_WORD}) adults? and (\d+|{NUMBER_WORD}) {KID_WORD}\b"
WITH_PARENTS = r"\b(?:live|living|stay|staying|moved back) (?:in )?with my (?:parents|mom and dad)\b"
WITH_A_PARENT = r"\b(?:live|living|stay|staying|moved back) (?:in )?with my (?:mom|mother|dad|father)\b"
RELATIVE = r"(?:mom|mother|dad|father|grandma|grandmother|grandpa|grandfather|aunt|uncle|sister|brother|cousin|roommate|friend|nephew|niece)"
COHABITANT = rf"\b(?:my|our) {RELATIVE} (?:and (?:i|me)\b|(?:lives|is living|stays|is staying|moved in) with (?:me|us)\b)|\b(?:me and|i and) my {RELATIVE}\b"
AGES = [
    r"\b(?:i'm|i am|age|aged|i'm turning)\s+(\d{2})\b(?!\s*(?:months|weeks|hours|%|k|,\d|\d))",
    r"(?<!\b(?:my|our|a|his|her)\s)\b(\d{2})[- ]years?[- ]old\b",
    r"\b(\d{2})\s*(?:yo|y\/o|yrs old)\b",
]
PREGNANT = r"\b(?:pregnan\w*|expecting (?:a baby|our first|my first)|baby (?:is )?due|due in (?:january|february|march|april|may|june|july|august|september|october|november|december|\w+ (?:weeks|months)))\b"

# Money.
PERIOD = r"(?:per|a|an|each|every|/)\s*(month|mo|monthly|mth|week|wk|weekly|year|yr|annually|annual|hour|hr|hourly|paycheck|2 weeks|two weeks|biweekly|bi-weekly|fortnight)"
HOURS_A_WEEK = r"\b(\d{1,2})\s*(?:hours?|hrs?)?\s*(?:a|per|\/|each|every)\s*(?:week|wk)\b|\bhours (?:dropped|cut|down|went|reduced|are now)(?: down)? to (\d{1,2})\b|\b(\d{1,2}) hours? (?:a|per) week\b"
IDLE = r"\b(?:lost|no|without) (?:my |a )?(?:job|work)\b|\blaid off\b|\bunemployed\b"
HOUSING_COST = rf"\b(?:rent|mortgage)\b(?: payment)?(?: is| was| of| costs?| runs?)?(?: about| around| like| roughly)?\s*(\$\s?)?(\d[\d,]*)(?:\s*{PERIOD})?|(?:pay|paying|spend|spending)(?: about| around| like)?\s*(\$\s?)?(\d[\d,]*)(?:\s*{PERIOD})?\s*(?:a month\s*)?(?:for|in|on) (?:my |our |the )?(?:rent|mortgage)\b"
DEBT_BEFORE = r"\b(?:back|owe|owed|behind)\s*$"
EXPENSE_CUE = r"\b(?:rent|lease|bill|bills|owe|owed|owing|deposit|behind|back rent|late fee|mortgage|cost|costs|costing|charging|charges|spend|spending|debt|utilities|pg&e|pge)\b"
INCOME_CUE = r"\b(?:make|makes|making|made|earn|earns|earning|earned|income|bring(?:s|ing)? (?:home|in)|take(?:s)? home|paid|paycheck|salary|wage|wages|get paid|gets paid|receive|receives|receiving|getting|get|gets|on (?:social security|ssi|ssdi|disability|unemployment|a pension|pension|retirement)|from (?:social security|ssi|ssdi|disability|unemployment|work|my job|a pension|retirement)|social security|pension|unemployment|combined|together|total|budget|living on|live on|support us on)\b"
NO_INCOME = r"\b(?:no|zero|without any|don't have any|not making any|no longer have any) (?:income|money|money coming in|paycheck|earnings)\b|\bnot working (?:right now|at all|anymore)\b|\bnot earning anything\b|\bbroke\b(?! down)"
UNEARNED_CUE = r"\b(?:social security|ssi|ssdi|disability (?:check|benefits|payments?|income)|on disability|from disability|unemployment|edd|pension|retirement|calworks|cash aid|child support|alimony|general assistance|va (?:benefits|disability))\b"
EARNED_CUE = r"\b(?:make|makes|making|made|earn|earns|earning|paycheck|salary|wages?|hourly|an hour|per hour|\/hr|at work|my job|part[- ]time|full[- ]time|shifts?|self[- ]employed|gig|uber|lyft|doordash|instacart|tips)\b"
INCOME_AFTER = r"^\s*(?:from|in (?:benefits|income|ssi|ssdi|social security)|income|combined|total|take[- ]home|after tax(?:es)?|a month from|from my job|(?:of |in )?(?:social security|ssi|ssdi|disability|unemployment|pension|retirement|calworks|child support|alimony))\b"
OTHER_EARNER = r"\b(?:wife|husband|partner|spouse|boyfriend|girlfriend|son|daughter|mom|dad|mother|father|roommate|he|she)\b[^.!?;]{0,20}$"

# Words of each need, and the order in which needs are listed.
NEEDS = {
    "rental_assistance": r"\b(?:rent|rental|landlord|lease|deposit|move[- ]in|back rent|behind on|eviction|evicted|housing (?:help|assistance|costs?)|keep (?:my|our) (?:apartment|place|housing|home)|(?:cheaper|affordable|low[- ]income|subsidized) (?:place|apartment|housing|home|unit)|(?:need|find|finding|looking for|search(?:ing)? for) (?:an? |new |another |cheaper )?(?:apartment|place to (?:rent|live)|housing)|overcrowded|section 8|housing voucher|mortgage|foreclos\w*)\b",
    "food": r"\b(?:food|grocer(?:y|ies)|hungry|hunger|starv\w*|nothing to eat|enough to eat|anything to eat|haven't eaten|skipping meals|meals?|feed (?:my|our|the) (?:kids|family|children|baby|son|daughter)|calfresh|snap|ebt|food stamps|food bank|pantry|wic|formula|diapers)\b",
    "utility": r"\b(?:utilit(?:y|ies)|pg ?& ?e|pge|electric(?:ity)?|power (?:bill|got|was|is|shut|cut|off)|lights (?:got |were |are )?(?:shut|cut|turned) off|gas bill|heat(?:ing)?|water bill|shut[- ]?off|disconnect(?:ed|ion|ing)?|energy bill|internet|wi-?fi|phone (?:bill|service)|cell (?:phone )?bill|propane|trash bill|sewer bill|liheap)\b",
    "shelter": r"\b(?:shelter|(?:place|somewhere|anywhere) to (?:sleep|stay|live)|nowhere to|no ?where to|homeless|unhoused|roof over|housing tonight|bed tonight)\b",
    "employment": r"\b(?:jobs?|(?:find|finding|looking for|need|get|got|lost|losing) (?:a |my |some )?(?:work|job)|employment|unemployed|laid off|let go|fired|out of work|hours (?:got |were |have been )?(?:cut|reduced|dropped)|hiring|resume|job training|worksource|worknet|can't find (?:a )?(?:job|work)|need (?:more )?hours|job search|(?:got )?out of (?:jail|prison)|reentry|re-entry|get to work)\b",
    "legal": r"\b(?:court|lawyer|attorney|legal|lawsuit|sued|suing|summons|unlawful detainer|eviction defense|tenant rights|my rights|restraining order|immigration|wage theft|unpaid wages|(?:boss|employer|job|company) (?:isn't|is not|won't|didn't|hasn't|never|stopped) pay\w*|(?:criminal )?record|expunge\w*|parole|probation|(?:got )?out of (?:jail|prison)|debt collectors?|garnish\w*|divorce|custody|deport\w*)\b",
    "health": r"\b(?:health insurance|health care|healthcare|medical|doctors?|clinic|hospital|medi[- ]?cal|medicaid|medicare|prescriptions?|medication|meds|dental|dentist|pregnan\w*|maternal|insurance lapsed|uninsured|covered california|medicines?|insulin|inhaler|glasses|eye (?:exam|doctor)|urgent care|emergency room|sick|injur(?:y|ed)|surgery)\b",
    "benefits": r"\b(?:benefits?|calworks|calfresh|ssi|ssdi|cash aid|cash assistance|general assistance|public assistance|financial (?:assistance|hardship|help)|finances? (?:are )?(?:starting to )?(?:slip|fall|falling apart)|apply for (?:aid|assistance)|food stamps|wic|unemployment(?: benefits| insurance| claim)?|edd|eitc|tax credit|social security|need (?:some )?(?:money|cash)|money is tight|tight on money|(?:can't|cannot) make ends meet|paycheck to paycheck|struggling financially|out of money|ran out of money|no money|broke(?! down)|transportation|ride to|bus pass|car (?:broke down|repair)|clothes|clothing)\b",
    "family_support": r"\b(?:child ?care|daycare|day care|domestic violence|abus(?:e|ive|ed)|pregnan\w*|foster|diapers|formula|parenting (?:help|class|support)|custody|newborn|head start|abusing|abuser|(?:hits?|hitting|beats?|beating|threaten\w*|stalk\w*|chok\w*) me|unsafe at home|clothes for (?:my |our )?(?:kids|children|son|daughter|baby)|school supplies|car seat|crib)\b",
    "veteran_support": r"\b(?:veterans?|va (?:benefits|disability|claim)|calvet|military)\b",
    "older_adult_support": r"\b(?:seniors?|older adults?|aging|elderly|retired|retirement|in[- ]home care|caregiver|caregiving|alzheimer'?s|dementia|memory)\b",
    "disability": r"\b(?:disabilit(?:y|ies)|disabled|ihss|developmental services|assistive|wheelchair|accessib\w+|autis\w+|special needs|regional center|blind|deaf|hard of hearing|down syndrome|cerebral palsy)\b",
    "mental_health": r"\b(?:mental health|behavioral health|depress(?:ed|ion)|anxiety|ptsd|counsel(?:ing|or)|therap(?:y|ist)|suicid\w*|self[- ]?harm(?:ing)?|(?:hurt|harm|kill)(?:ing)? myself|end(?:ing)? my life|bipolar|schizophreni\w*|panic attacks?|crisis line|psychiatrist|overwhelmed|(?:can't|cannot) cope|hopeless|trauma|grie(?:f|ving)|mental breakdown)\b",
    "substance_use": r"\b(?:substance (?:use|abuse)|addict(?:ed|ion)|(?:in )?recovery|relaps(?:e|ed|ing)|(?:recently )?off the wagon|rehab|detox|opioids?|fentanyl|meth(?:amphetamine)?|heroin|cocaine|sober|sobriety|drinking problem|alcoholi\w+|drug (?:use|problem))\b",
    "condition_support": r"\b(?:diabetes|diabetic|cancer|hiv|aids|heart (?:disease|failure|condition)|kidney (?:disease|failure)|dialysis|asthma|copd|chronic (?:illness|pain|condition)|epilepsy|seizures)\b",
}
NEED_PRIORITY = ["mental_health", "substance_use", "shelter", "rental_assistance", "utility", "legal", "employment", "benefits", "family_support", "health", "disability", "condition_support", "food", "veteran_support", "older_adult_support"]

LEGAL_DENIAL_BEFORE = r"\b(?:no|not yet|haven't|hasn't|never)\b[^.!?;]{0,15}$"

# Words of each reported condition.
CONDITIONS = {
    "disability": r"\b(?:disabled|disability|developmental disability|intellectual disability|on ssdi|autis\w+|down syndrome|cerebral palsy|blind|deaf)\b",
    "mobility_impairment": r"\b(?:wheelchair|mobility (?:impairment|issue|disability|problems?)|paraly[sz](?:ed|is)|amputee|walker|can't walk)\b",
    "mental_health_condition": r"\b(?:mental health|depression|depressed|anxiety|ptsd|bipolar|schizophreni\w*|self[- ]?harm(?:ing)?|suicid\w*|(?:hurt|harm|kill)(?:ing)? myself|end(?:ing)? my life)\b",
    "substance_use_disorder": r"\b(?:substance (?:use|abuse)|addict(?:ed|ion)|alcohol use disorder|drug use disorder|in recovery|relaps(?:e|ed|ing)|off the wagon|meth(?:amphetamine)?|fentanyl|cocaine|heroin|alcoholi\w+)\b",
    "diabetes": r"\b(?:diabetes|diabetic)\b",
    "cancer": r"\bcancer\b",
    "chronic_illness": r"\b(?:chronic illness|chronic condition|chronic pain|chronically ill)\b",
    "heart_disease": r"\b(?:heart disease|heart failure|heart condition|heart attack)\b",
    "kidney_disease": r"\b(?:kidney disease|renal disease|kidney failure|dialysis)\b",
    "respiratory_condition": r"\b(?:asthma|copd|emphysema|respiratory condition)\b",
    "hiv_aids": r"\b(?:hiv|aids)\b",
}

# Short forms and what they stand for.
SHORT_FORMS = [
    (r"\bim\b", "i'm"),
    (r"\bcant\b", "can't"),
    (r"\bdont\b", "don't"),
    (r"\bwont\b", "won't"),
    (r"\bhavent\b", "haven't"),
    (r"\bdidnt\b", "didn't"),
    (r"\bisnt\b", "isn't"),
    (r"\bwasnt\b", "wasn't"),
    (r"\bdoesnt\b", "doesn't"),
    (r"\bcouldnt\b", "couldn't"),
    (r"\bw\/o\b", "without"),
    (r"\bw\/\s?", "with "),
    (r"\b(?:bc|b\/c|cuz|cause)\b", "because"),
    (r"\btmrw\b|\btmr\b", "tomorrow"),
    (r"\bu\b", "you"),
    (r"\br\b", "are"),
    (r"\bn\b", "and"),
    (r"\bppl\b", "people"),
    (r"\bmo\b", "month"),
]

# Rules that a programme's page states.
ANNUAL_INCOMES = [
    r"\b(?:earning|earns|income|incomes|gross income|annual income|yearly income)[^$\d]{0,45}\$\s*([\d,]+)\s*(?:a|per|each)?\s*(?:year|yr|annually)\b",
    r"\b(?:not more than|maximum income(?: allowed)?)[^$]{0,20}\$\s*([\d,]+)\b",
    r"\b(?:under|below|less than|no more than|up to)\s+\$\s*([\d,]+)\s*(?:a|per|each)?\s*(?:year|yr|annually)\b",
]
AREA_PERCENT = r"\b(\d{2,3})\s*(?:%|percent)\s*(?:of\s+)?(?:the\s+)?(?:area median income|ami|median income)\b"
POVERTY_PERCENT = r"\b(\d{2,3})\s*(?:%|percent)\s*(?:of\s+)?(?:the\s+)?(?:federal poverty (?:level|line|guidelines?)|poverty (?:level|line|guidelines?)|fpl)\b"
STATE_PERCENT = r"\b(\d{2,3})\s*(?:%|percent)\s*(?:of\s+)?(?:the\s+)?state median income\b"
SOME_INCOME_LIMIT = r"\b(?:low[- ]income|income[- ]eligible|income[- ]qualified|income limits? appl(?:y|ies))\b"
VETERANS_ONLY = r"\b(?:must be (?:a )?veterans?|veterans? only|only (?:for|to) (?:eligible )?veterans|for (?:eligible|homeless|low-income) veterans|veterans and their families|serves veterans)\b"
WITH_CHILDREN = r"\b(?:families with (?:minor |dependent )?children|households with (?:minor |dependent )?children|must have (?:a|at least one) (?:minor |dependent )?child|families (?:in|receiving|on|enrolled in) (?:the )?calworks(?: program)?)\b"
FOR_HOMELESS = r"\b(?:experiencing homelessness|who are homeless|homeless (?:individuals|families|adults|youth|people)|people experiencing homelessness|are homeless)\b"
FOR_AT_RISK = r"\b(?:at risk of (?:homelessness|losing (?:their |your )?(?:housing|home)|eviction)|risk of homelessness|past[- ]due rent|behind on (?:their |your )?rent|eviction prevention|avoid(?:ing)? eviction|prevent eviction|eviction avoidance|homelessness prevention|facing eviction)\b"
NOTICE_REQUIRED = r"\b(?:must have (?:received )?(?:an? )?(?:eviction |written |court )?notice|with an eviction notice|received an? (?:eviction|3-day|three-day|pay or quit) notice|unlawful detainer (?:case|filed|lawsuit))\b"
CASH_AID_REQUIRED = r"\b(?:calworks (?:recipients?|participants?|families|applicants?)|in the calworks program|receiving calworks|families in calworks)\b"
ADULT_PROTECTION = r"\b(?:adult protective services|aps clients?)\b"
CHILD_WELFARE = r"\bchild welfare\b"
RESIDENT_OF = r"\bresident of ([A-Z][\w .]+? County)(?: for at least (\d+|thirty|sixty|ninety) days)?"
POSTCODES_BEHIND, POSTCODE = r"\bzip codes?\b(.{0,600})", r"\b9\d{4}\b"
NOTES = {
    "state_percent": "Income limit %s%% of state median income.",
    "some_limit": "Income limits apply; the amounts are not published on the page.",
    "cash_aid": "Must be receiving (or applying for) CalWORKs.",
    "adult_protection": "Must be an Adult Protective Services client or in APS intake.",
    "child_welfare": "Family must be involved with the child welfare system.",
    "resident": "Must be a resident of %s%s.",
    "resident_days": " for at least %s days",
    "postcodes": "Serves ZIP codes %s.",
}
