"""General word lists for abusive, hateful and sexual language. Fixed values; lower case, in six languages.

The lists hold common vocabulary, written without looking at any corpus. An asterisk at the end stands for any ending. What a
corpus says in its own words is learned from its labels (``abuse.Learned``), not listed here.
"""

_LISTS = {
    # Names that insult a person.
    "insult": """idiot* moron* imbecile* cretin* fool fools dimwit* nitwit* halfwit* half-wit* airhead* blockhead* bonehead* numbskull* dunce* simpleton* ignoramus* buffoon* jerk* creep* weasel* maggot* bastard* asshole* arsehole*
        dickhead* prick pricks cunt* twat* wanker* tosser* bellend* douche* scumbag* dirtbag* sleazebag* shithead* shitbag* dipshit* dumbass* jackass* smartass* fuckwit* fuckface* fucker* motherfucker* cocksucker* bitch* slut* whore* skank* loser* failure failures coward* liar liars
        fraud frauds clown clowns joke disgrace* freak freaks psycho* lunatic* nutcase* nutjob* degenerate* pervert* lowlife* low-life* thug* crook* scammer* snake leech* parasite* scum trash garbage filth waste vermin swine pig pigs rat dog toad hag troll trolls retard* spastic* git
        idiota* vollidiot* trottel* dummkopf* arschloch* wichser* hurensohn* mistkerl* drecksack* schwein schweine versager* penner* schwachkopf* miststück* missgeburt* schlampe* depp* feigling* lügner* betrüger* blödmann* abschaum
        imbécil* imbecil* gilipollas cabrón cabron cabrones pendejo* puta putas puto putos zorra* cerdo* cobarde* mentiroso* estúpido* estupido* basura tonto tonta escoria inútil* payaso* malnacido* capullo*
        connard* connasse* salaud* salope* abruti* crétin* imbécile* enculé* ordure* pute putes lâche* menteur* raclure* minable* pourriture* bouffon* débile* merdeux
        otário* otario* babaca* cretino* burro burra vagabundo* vagabunda* covarde* mentiroso* lixo desgraçado* canalha* palhaço* corno arrombado* fracassado*
        идиот* дебил* урод* козёл козел козлы тварь твари мразь мрази сволочь сволочи придурок придурки скотина ублюдок ублюдки сука суки дурак дура дураки кретин* тупица ничтожество подонок подонки гнида лжец трус мерзавец отброс* шлюха""",
    # Words that belittle.
    "belittle": """stupid* dumb dumber dumbest worthless pathetic* useless spineless brainless gutless clueless ignorant incompetent* miserable disgusting* repulsive vile filthy ugly fat lazy dirty rotten braindead brain-dead half-baked talentless hopeless laughable ridiculous inferior sick twisted crazy insane nasty stinking lousy
        fucking fuckin goddamn bloody shitty crappy shit
        dumm dummer dumme dummes blöd* hässlich* wertlos* nutzlos* erbärmlich* ekelhaft* widerlich* verdammt* verfickt* dreckig* faul fett feige scheiß* jämmerlich*
        inútil asqueros* patétic* feo fea gordo gorda repugnante* maldit* miserable ridícul* jodid* ignorante*
        sale sales stupide* nul nulle inutile* minable* pathétique* dégoûtant* moche* pourri* ridicule* foutu* putain
        inútil patétic* nojent* feio feia gordo podre* maldit* idiota ridícul* imund* miserável burr*
        тупой тупая тупые тупое жалкий жалкая жалкие никчёмн* никчемн* бесполезн* мерзк* уродлив* грязный грязная проклят* вонюч* отвратительн* убог*""",
    # Violence against a person.
    "violence": """kill* murder* shoot shot stab* strangl* chok* hang hanged lynch* burn* beat beaten beating smash* break broken crush* slit slash* cut gut skin bury buried drown* poison* punch* kick* slap* whip* hurt harm attack* destroy* hunt rip tear snap crack bash* batter* behead* shank* cripple maim* torture* bomb* acid
        umbring* töten tot schlag* schlage erschieß* erstech* erwürg* brech* verprügel* abstech* vernicht* zerschmetter* hängen verbrenn*
        matar mataré mato romper rompo golpear disparar apuñal* estrangular quemar ahorcar destruir degollar reventar* partir*
        tuer tuerai buter frapper casser briser étrangler poignarder brûler égorger crever exploser écraser démolir
        matar mato quebrar bater espancar esfaquear estrangular queimar enforcar destruir arrebentar
        убью убить убьём зарежу задушу сломаю разобью избить избью прибью застрелю уничтож* повешу сожгу""",
    # Body parts, weapons and outcomes that go with violence.
    "injury": """teeth tooth fingers bones neck throat skull face legs kneecaps ribs jaw arms knife gun bullet bullets rope noose bat axe grave graves coffin blood bleed bleeding hospital pieces regret suffer pain dead die dies dying death rot hell
        zähne finger knochen hals fresse gesicht messer pistole grab blut sterben stirb verreck* tod hölle krepier*
        dientes dedos huesos cuello cara cuchillo pistola tumba sangre muere mueras morir muerte infierno pudras
        dents doigts os cou gorge gueule couteau pistolet tombe sang meurs mourir mort enfer
        dentes dedos ossos pescoço cara faca pistola cova sangue morra morrer morre morte inferno
        зубы пальцы кости шею горло лицо нож пулю могил* кровь сдохни сдохнешь умри умрёшь умрешь смерть ад""",
    # Groups that people belong to by origin, belief, sex, orientation, age or disability.
    "group": """immigrant* migrant* foreigner* refugee* asylum-seeker* alien aliens outsiders natives ethnic* minority minorities race races racial tribe tribes nationality
        gay gays lesbian* homosexual* bisexual* transgender* trans transsexual* queer queers faggot* dyke dykes tranny trannies
        women woman females girls feminists wives widows men mothers disabled wheelchair cripples handicapped deaf blind autistic autists elderly pensioners seniors boomers
        black blacks white whites asian asians arab arabs african africans indian indians chinese japanese korean koreans mexican mexicans latino latinos hispanics turk turks turkish russians poles polish ukrainians gypsy gypsies roma romani
        jew jews jewish muslim* moslem* islam christian* catholic* protestants hindu* sikh* buddhist* mormon* atheist* believer* infidel* heathens
        nigger* negro* kike* spic* chink* gook* paki pakis wetback* raghead* towelhead*
        ausländer* flüchtling* migrant* schwule* lesben behinderte* behinderten juden muslime moslems christen frauen weiber türken araber zigeuner* neger alte greise rentner schwarze* asylant*
        inmigrante* extranjer* refugiad* maricones maricas homosexuales mujeres judíos moros musulmanes gitan* negros viejos discapacitados ancianos
        immigré* migrants étranger* réfugié* pédés homosexuels femmes juifs musulmans arabes gitans noirs vieux handicapés
        imigrante* estrangeir* refugiad* gays viados bichas mulheres judeus muçulmanos árabes ciganos negros velhos deficientes idosos
        мигрант* беженц* иностранц* чужак* гомосексуал* геи геев женщин* бабы евре* мусульман* цыган* инвалид* старик* чёрные чурк* жиды""",
    # Ways to speak of a group without naming it.
    "collective": """they them their theirs these those people folk folks kind lot sort breed race everyone everybody all every
        sie ihnen ihre diese leute alle volk pack sippe ellos ellas esos esas gente todos ils elles ces gens tous eles elas esses essas gente todos они их эти эта все всех люди племя""",
    # What only contempt calls people.
    "dehumanise": """vermin rats cockroach* roaches insects lice pests pest plague disease cancer virus infection infest* parasites animals beasts savages monkeys apes pigs dogs swine subhuman* sub-human* filth scum dirt trash garbage rubbish inhuman inferior* unnatural abomination* evil demons devils breed* swarm* criminals thieves thief terrorists rapists liars invaders primitive uncivilised uncivilized backward
        stink smell blood degenerate* halfwits half-wits imbeciles
        ungeziefer ratten kakerlaken seuche krankheit parasiten tiere abschaum untermenschen minderwertig* affen dreck schmarotzer* verbrecher diebe
        plaga ratas cucarachas enfermedad parásitos animales escoria basura infrahumanos inferiores ladrones criminales bestias
        vermine rats cafards maladie parasites animaux racaille sous-hommes inférieurs voleurs criminels déchets nuisibles
        praga ratos baratas doença parasitas animais escória lixo sub-humanos inferiores ladrões criminosos bandidos
        паразит* крысы тараканы зараза животные недочеловек* отбросы мусор грязь воры преступник* нелюди звери""",
    # Calls to exclude or harm a group, and claims that it deserves less.
    "exclude": """deport* expel* exterminat* eradicat* eliminat* purge* cleans* ban banned banish* deserve deserves allowed belong belongs right rights vote citizens equal superior serve kitchen cage caged cages camps camp gas gassed segregat* sterilis* sterilize* burden leech* steal stealing rob ruin* destroy* invade* invading replac* contaminat* infect* hate hated despise* loathe country borders home back out rid
        abschieb* ausrott* vernicht* einsperren raus rauswerfen verbieten verdienen gehören wählen vergasen klauen stehlen
        deportar expulsar exterminar eliminar encerrar echarlos fuera merecen votar roban prohibir cárcel
        expulser déporter exterminer éliminer enfermer dehors méritent voter volent interdire virer chasser
        deportar expulsar exterminar eliminar prender fora merecem votar roubam proibir
        депортировать выгнать гнать истребить уничтожить запереть вон заслуживают воруют запретить""",
    # Parts and acts that also occur in plain speech.
    "sensual": """naked nude nudity breasts breast nipples nipple thighs butt buttocks ass arse kiss kissed kissing lick* suck* stroke* stroking touch* caress* moan* gasp* grope* thrust* undress* strip stripped stripping bare body lips tongue bed wet hard hot sexy sexual sex erotic lust* desire panties bra underwear lingerie lap cam webcam video videos pics photos escort* escorts massage lover lovers mistress climax aroused arousal seduc* intercourse penetrat* penis vagina spread ride riding rode
        nackt* brüste sexy geil* küss* leck* stöhn* ausziehen körper schenkel desnud* pechos besar lamer gem* cuerpo muslos caliente*
        nu nue nus nues seins sexe embrass* léch* gémi* corps cuisses chaude* nua nuas seios beij* lamb* gem* corpo coxas tesud*
        голый голая голые голых грудь груди секс целова* лиза* стон* бёдра тело""",
    # Words that are explicit by themselves.
    "explicit": """fuck fucked fucks cock cocks pussy pussies dick dicks cum cums cumming cumshot* tits titties boobs blowjob* handjob* rimjob* deepthroat* dildo* vibrator* horny orgy orgies orgasm* masturbat* jerked porn* xxx hardcore milf* threesome* gangbang* creampie* anal fisting bukkake fetish* bdsm bondage nudes sexting hookup* clit* ejaculat* erection* sodom* hentai camgirl* striptease*
        fick* ficken muschi* schwanz titten wichsen porno* blasen geile geiler möse orgie*
        follar follamos follando polla* coño tetas correrme porno* mamada* verga* orgía* cachonda* cachondo*
        baise baiser bite bites chatte* nichons porno* pipe branler jouir partouze*
        foder fodendo transar buceta* pau peitos porno* pornô boquete* gozar tesão suruba* punheta*
        трах* трахать хуй хуя член сиськи пизд* порно* отсос* минет* кончил* ебать ебал ебля оргия""",
    "you": "you your yours yourself yourselves u ur ya y'all du dich dir dein deine deinen deinem deiner ihr euch eure tú tu te ti tus vosotros os toi tu te ton ta tes vous votre vos você vocês seu sua seus suas teu tua contigo ты тебя тебе тобой твой твоя твои твою вы вас вам ваш ваши",
    "person": "he she him her his hers vendor seller shipper admin staff team clerk courier packer moderator mod guy man dude boss support verkäufer er ihm ihn vendedor él ella vendeur il elle vendedor ele ela продавец он она его её",
    "me": "i me my myself mine i'm i've ich mich mir mein meine yo mi mí je moi mon ma mes eu meu minha mim я меня мне мой моя",
    # Words of reports, rules and care.
    "report": "told said says report* reported quoted quote complain* complaint* moderat* removed remove banned ban rule rules forbidden forbid* survey* research* study studies warned warning* threaten* threats alleg* accus* police court convicted article news journalist* word words term slur slurs insult insults insulted abuse abusive abused harass* hate-speech policy policies zero-tolerance gemeldet berichtet sagte verbot* denunci* informe* prohib* signal* rapport* interdit* dit relat* proibid* disse сообщ* сказал* запрещ* правил*",
    "care": "clinic* clinician* doctor* nurse* midwife hospital* health* medical medicine* patient* pharmac* leaflet* helpline* therap* symptom* treatment* treat condom* contracept* pregnan* period periods cycle menstru* bleeding cramps cancer-screening screening infection* infections intercourse ovulation fertility sti stis hiv education* consent advice advise* tablet* pill pills dose dosage cream gel insert arzt ärzt* klinik* gesundheit* schwanger* verhüt* médic* clínic* salud embaraz* anticoncep* médecin* santé enceinte* grossesse* contracep* saúde gravid* grávid* врач* клиник* здоров* беремен* контрацеп*",
    "thing": "packaging tape box boxes parcel* package* strip strips blister* foil bottle* carton envelope* label* price* postage delivery post mail weather site website browser app printer queue weekend day week traffic thing things stuff order tracking shipping seal bag lid cap",
    "negate": "not no never don't doesn't didn't won't isn't aren't nobody none nothing without stop nicht kein keine nie nunca jamás no pas jamais aucun não nunca не нет никогда",
}
# Phrases, each with the list whose word it counts as.
PHRASES = {
    "violence": ["know where you live", "find out where you live", "come for you", "coming for you", "come after you", "hunt you down", "find you", "watch your back", "finish you", "end you", "make you pay", "pay for this", "sleep with one eye open", "make you regret", "get what you deserve", "get what's coming", "kick your ass", "kick your head", "beat you up", "put you in the ground", "put you in hospital", "weiß wo du wohnst", "weiss wo du wohnst", "wir finden dich", "ich finde dich", "sé dónde vives", "voy a encontrarte", "te voy a encontrar", "je sais où tu habites", "je vais te trouver", "sei onde você mora", "vou te achar", "знаю где ты живёшь", "знаю где ты живешь", "найду тебя"],
    "insult": ["piece of shit", "pile of shit", "sack of shit", "son of a bitch", "waste of space", "waste of air", "waste of oxygen", "waste of skin", "shut up", "shut your mouth", "shut your face", "screw you", "fuck you", "fuck off", "piss off", "go to hell", "drop dead", "kill yourself", "go die", "eat shit", "kiss my ass", "you people make me sick", "halt die fresse", "halts maul", "halt die klappe", "verpiss dich", "fick dich", "geh sterben", "vete a la mierda", "cierra la boca", "hijo de puta", "que te jodan", "ferme ta gueule", "ta gueule", "va te faire foutre", "fils de pute", "vai se foder", "cala a boca", "filho da puta", "vai à merda", "закрой рот", "заткнись", "пошёл ты", "иди к чёрту", "иди на хуй"],
    "exclude": ["go back to", "send them back", "send them home", "get rid of", "kick them out", "throw them out", "lock them up", "round them up", "wipe them out", "wiped out", "wipe out", "keep them out", "should be shot", "should be banned", "should be locked", "should not be allowed", "shouldn't be allowed", "has no place", "have no place", "don't belong", "do not belong", "not human", "not people", "not real", "less than human", "second class", "second-class", "do not deserve", "don't deserve", "no right to", "not welcome", "all the same", "know their place", "stay in the kitchen", "keine menschen", "alle gleich", "no son personas", "todos iguales", "pas des humains", "tous les mêmes", "não são gente", "todos iguais", "не люди"],
    "explicit": ["make love", "made love", "have sex", "having sex", "had sex", "sex cam", "live cam", "hot girls", "hot singles", "take off your clothes", "on my knees", "on her knees", "between her legs", "between my legs", "inside her", "inside me", "deep inside", "spread her legs", "spread your legs", "suck my", "ride my", "bend over", "send pics", "adult content", "sex toys"],
}
NAMES = list(_LISTS)
LISTS = {k: sorted(set(v.split())) for k, v in _LISTS.items()}
