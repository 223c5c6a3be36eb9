"""Passages written for this package to US school grades, on many subjects; `reading` is calibrated to them.

Each is (grade, text). They were written to a grade by what readers of it are taught to follow: grades 2 to 5 in short
main clauses of everyday words, grades 7 to 12 in joined clauses of general words, grades 14 and up in the nested
clauses and special terms of college texts. Passages of a first draft that came out much harder than meant were written
again; the grades are those meant, no formula gave them.
"""

# The graded passages.
PASSAGES = [
    (2, "The dog ran to the gate. A man was there with a red box. He put the box down and gave the dog a pat. The dog sat on the mat. We took the box in the house. It had a big cake in it. Mom cut the cake and we all ate a bit. The dog got one too."),
    (2, "You can find the file on the desk. Open it and look at the first line. It shows the name of the list. Pick one name and hold it. Then drop it in the new box. If the box is full, take one thing out. Do not move the last name. It has to stay where it is."),
    (3, "A plant needs light and water to grow. The roots hold it in the ground. They drink the water and send it up to the leaves. The leaves use the light to make food. If the soil is dry, the plant will bend. Give it a cup of water and it will stand up again the next day."),
    (3, "We keep a log of each test. The log tells us what went wrong. When a test fails, read the log from the top. Look for the word that is not right. Fix it and run the test once more. Do this until all the tests pass. Then save your work and close the page."),
    (4, "Last summer my brother and I built a small boat out of old wood. It took us three weeks. First we drew a plan on paper. Then we cut the boards and nailed them to the frame. When it was done, we painted it blue. The boat leaked a little, but it carried both of us across the pond."),
    (4, "The program reads a file and checks every line. If a line is good, it goes into the new list. If a line is bad, the program skips it and makes a note. At the end it counts the notes. You can see the number on the last page. Use it to find out how many lines were lost on the way."),
    (5, "Bees live together in a hive, and every bee has its own work to do. Some bees clean the cells while others guard the opening. The oldest bees fly out to look for flowers. When a bee finds a good meadow, she flies home and dances to show the others the way. Then they all travel there to gather the sweet juice and carry it back."),
    (5, "Before you start the tool, make sure that the disk has enough empty space. The tool makes a copy of every page, so it needs room for two of each. It compares the copies when the work is finished. If a copy is the same as the first page, the older one is removed. This keeps the folder clean and saves a little money."),
    (5, "Long ago people told the time by the sun. They put a stick into the ground and watched its shadow move. In the morning the shadow was long and pointed to the west. At noon it became very short. This worked well on sunny days, but on cloudy days nobody knew how late it was. Later they invented clocks that ran on sand or water."),
    (7, "When the first railroads crossed the plains, they changed the lives of the people there. Farmers could now send their wheat to the cities before it spoiled. Settlers brought tools that had been too heavy to carry in a wagon. But the tracks also cut through the hunting grounds of native families, who were slowly pushed away from their land."),
    (7, "Every request that enters the server first waits in a queue until a worker is free. The worker reads the message, compares it with the stored record, and sends an answer to the client. If the record has changed in the meantime, the server rejects the request. It also reports the reason, so that the client can try again later."),
    (7, "A desert may look empty, but many animals live there and stay out of sight during the day. Snakes and lizards rest under the rocks while the sun is high. Some small mammals dig tunnels where the air remains cool. After sunset they leave their shelters and search for food. Most of them hardly ever drink, because they get enough water from the seeds and insects they eat."),
    (7, "The update removes old entries from the list before it adds the new ones. It first checks whether the file is open in another window. If the file is open, the update waits for a moment and then tries again. You can follow its progress in the panel below the editor. When everything is finished, the panel shows how many entries were changed and closes after a few seconds."),
    (7, "The village doctor was known for her patience. She listened to every complaint, even when the story was long and the illness was short. People said that half of her medicine was silence. In winter she travelled by sled from one farm to the next, and the farmers paid her with eggs or firewood. She wrote each visit in a small green notebook that never left her pocket."),
    (8, "The human heart is a muscle about the size of a fist, and it pumps blood through the body without ever resting. Blood that has lost its oxygen enters the right side and travels to the lungs. There it collects a fresh supply and returns to the left side. The left side is stronger, because it must push the blood through the entire body."),
    (8, "Each folder in the project contains a module that handles one part of the process. The builder collects the modules, removes whatever is not needed, and writes the rest into a single package. When two modules use the same name, the builder reports an error. It never picks one of them by itself, because that could hide a serious mistake."),
    (9, "Although the novel was first sold as a story for children, its author included many jokes that only adults would understand. The characters often speak in riddles, and their strange arguments make fun of the lessons taught in schools of that time. Readers who return to the book later in life frequently discover meanings that they had overlooked before."),
    (9, "The cached response remains valid until the session expires or the owner updates the record. After a failed attempt, the handler restores the previous version and releases the lock. Other readers can then continue without any delay. A separate process examines the history every night and removes the entries that no active session needs."),
    (10, "During the early years of the Industrial Revolution, thousands of families moved from the country into crowded cities. The factories offered regular work, but conditions were often dangerous, and children labored beside their parents for twelve hours a day. Public anger finally persuaded the government to pass laws that limited working hours and required basic safety measures."),
    (10, "Once the change has been recorded, the service notifies every subscriber and waits until each of them has confirmed the message. Subscribers that do not answer within a minute are marked as missing, and their messages are stored for later delivery. This arrangement prevents a single slow receiver from delaying all others while the system is under heavy load."),
    (11, "The theory of moving plates, which most scientists rejected at first, explains how continents drift across the surface of the planet. Molten rock rises along ridges beneath the oceans, pushes the plates apart, and creates new crust as it cools. Where two plates collide, one of them may slide beneath the other, and the result is earthquakes and volcanoes."),
    (12, "A constitution not only describes the powers of a government but also limits them, because its authors feared that any power without control would be abused. For this reason they divided it among separate branches, each of which could stop the others from acting alone. Critics argue that such a system causes delay, yet its defenders prefer careful debate to hasty decisions."),
    (12, "The scheduler assigns every pending operation to a partition and balances the partitions by their expected duration, which it estimates from earlier executions. Whenever a partition takes much longer than expected, the remaining operations are divided among the workers that have already finished. The results are combined in a fixed order, so the number of workers does not change them."),
    (14, "Economic models that assume perfectly informed participants tend to underestimate the duration of a recession. Individuals revise their expectations slowly, since the information available to them is incomplete and unevenly distributed; consequently, investment remains depressed long after the original disturbance has disappeared. Institutional rigidities, particularly in the determination of wages, reinforce this tendency and complicate the interpretation of aggregate statistics."),
    (14, "The replication protocol guarantees eventual consistency, provided that every replica ultimately acknowledges the modifications it has received; nevertheless, applications that require stronger guarantees must coordinate explicitly. Such coordination introduces considerable communication overhead, particularly when the participating systems are geographically distributed, and therefore necessitates a careful evaluation of the performance characteristics involved."),
    (14, "Social scientists distinguish between the formal rules of an organization and the informal expectations that actually govern the behavior of its members. The former are documented, deliberately designed and relatively easy to modify; the latter develop gradually through repeated interaction. Reforms that concentrate exclusively on formal procedures therefore frequently produce disappointing results, because established expectations continue to influence everyday decisions."),
    (14, "The compiler performs several independent optimizations, although their combined effect is difficult to predict. Eliminating redundant expressions reduces the number of instructions, but it also increases register pressure, which may necessitate additional memory operations. Developers consequently evaluate each transformation experimentally, using representative applications instead of artificial examples, and retain only those that demonstrate a consistent improvement."),
    (14, "Medieval universities originated as voluntary associations of teachers and students, comparable in their organization to the professional guilds of the period. Their privileges, which included considerable independence from municipal authorities, were confirmed by papal or imperial documents. This legal autonomy subsequently proved essential for the development of critical scholarship, since controversial propositions could be debated without immediate political consequences."),
    (15, "Philosophical skepticism, notwithstanding its apparent incompatibility with empirical investigation, has contributed substantially to the sophistication of modern scientific inquiry. By repeatedly questioning the foundations of seemingly uncontroversial propositions, philosophers have compelled investigators to distinguish observation from theoretical interpretation, and thereby to acknowledge the provisional character of even their most successful generalizations."),
    (15, "Static verification of generic interfaces requires an intermediate representation whose properties are preserved under arbitrary transformation. Because conventional instrumentation only approximates such properties, developers are consequently obliged to supplement automated analysis with comprehensive documentation, particularly wherever dynamically created components circumvent the encapsulation that the architectural specification was intended to guarantee."),
    (16, "The pharmacological inhibition of this enzyme demonstrably reduces inflammation, although the therapeutic significance of the observation remains controversial owing to considerable individual variability. Randomized investigations of appropriately selected populations have additionally suggested that prolonged administration may cause irreversible metabolic complications, whose mechanisms are insufficiently characterized by the experimental methods presently available."),
    (16, "Authentication across independently administered repositories presupposes a cryptographic infrastructure whose complexity increases disproportionately with the number of participating organizations. It is accordingly inadvisable to confuse technical interoperability with organizational accountability, inasmuch as the administrative procedures necessary for comprehensive authorization are fundamentally different from whatever optimizations an individual implementation might incorporate."),
    (17, "Judicial interpretation of constitutional guarantees has historically alternated between originalist reconstruction and purposive generalization, neither of which satisfactorily accommodates the unanticipated technological circumstances of contemporary litigation. Appellate courts consequently continue to articulate balancing tests whose indeterminacy perpetuates substantial unpredictability throughout subordinate jurisdictions, irrespective of legislative clarification."),
    (18, "The ontological commitments presupposed by mathematical discourse cannot be straightforwardly eliminated through nominalistic paraphrase without simultaneously jeopardizing the explanatory indispensability that originally motivated their introduction. Consequently, proponents of fictionalist reinterpretation must demonstrate, rather than merely stipulate, that counterfactual applicability remains intelligible independently of referential success."),
]
