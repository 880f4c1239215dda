from understory.plans.commands import main

raise SystemExit(main())
